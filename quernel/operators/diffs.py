"""Contracts over changes and facts: pages of diffs, their fit with what is fresh, layers of facts, bodies that need no new parse, batches of queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .states import BLOCKING

#: How reliable a fact is, and the layer it belongs to.
LAYERS = {"provider_confirmed": "precise_provider", "parser_fallback": "parser", "config_fact": "config", "source_fact": "source"}
#: Verbs of a batch.
KINDS = ("semantic", "relationship", "config", "diff", "read", "source", "find", "grep", "symbols", "defs", "refs", "calls", "callers", "files", "status")
#: Rows of a query whose limit is 0 or larger than this.
MOST_ROWS = 1000


def diff_page(files: DataFrame, offset: int, limit: int) -> tuple[DataFrame, dict]:
    """Rows [offset, offset + limit) by path, and offset (no further than the end), limit, total, has_more. Only counts reach the driver."""
    total = files.count()
    start, end = min(offset, total), min(offset + limit, total)
    return files.orderBy("path").limit(end).offset(start), {"offset": start, "limit": limit, "total": total, "has_more": end < total}


def diff_alignment(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """path, blocked_roots of changed files while any root's manifest blocks: semantic facts of these may be out of date. Without a blocked root there are no rows."""
    blocked = manifests.where(F.col("state").isin(*BLOCKING)).agg(F.count_distinct("root_id").alias("blocked_roots")).where("blocked_roots > 0")  # one row at most
    return files.select("path").crossJoin(F.broadcast(blocked))


def layered(facts: DataFrame) -> DataFrame:
    """facts with the layer of their reliability; others go."""
    names = F.create_map(*(F.lit(x) for kv in LAYERS.items() for x in kv))
    return facts.withColumn("layer", F.try_element_at(names, F.col("reliability"))).where("layer is not null")


def split_layers(facts: DataFrame) -> dict[str, DataFrame]:
    own = layered(facts)
    return {layer: own.where(F.col("layer") == layer) for layer in LAYERS.values()}


def reusable_bodies(older: DataFrame, newer: DataFrame) -> DataFrame:
    """path, file_unchanged, reusable of files in both parses (path, file_hash, body_hash): the body hashes, calls' apart, that both have. Bodies meet by equality, never as one
    list beside another."""
    files = older.select("path", "file_hash").distinct().join(newer.select("path", F.col("file_hash").alias("new_hash")).distinct(), "path")
    shared = older.where("body_hash is not null").select("path", "body_hash").distinct().join(newer.select("path", "body_hash").distinct(), ["path", "body_hash"]).groupBy("path").agg(F.count("*").alias("reusable"))
    return files.join(shared, "path", "left").select("path", (F.col("file_hash") == F.col("new_hash")).alias("file_unchanged"), F.coalesce("reusable", F.lit(0)).cast("long").alias("reusable"))


def query_limit(limit: int, most: int = MOST_ROWS) -> tuple[int, bool]:
    """(rows that a query gives, whether the cap and not the limit bound it)."""
    return (limit, False) if 0 < limit <= most else (most, True)


@dataclass(frozen=True)
class BatchQuery:
    """One query of a batch: a verb, its arguments, and the names of queries that come before it."""

    name: str
    kind: str
    args: dict = field(default_factory=dict)
    after: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of query: {self.kind}")


def batch_order(batch: list[BatchQuery]) -> list[BatchQuery]:
    """The queries with every one after those it names, else as given; a name that isn't there or a circle is an error."""
    by_name, done, out = {q.name: q for q in batch}, set(), []
    if len(by_name) < len(batch):
        raise ValueError("two queries of one name")
    if missing := [a for q in batch for a in q.after if a not in by_name]:
        raise ValueError(f"no query named {missing[0]}")
    left = list(batch)
    while left:
        ready = next((q for q in left if set(q.after) <= done), None)
        if ready is None:
            raise ValueError("queries wait for each other: " + ", ".join(q.name for q in left))
        left.remove(ready)
        done.add(ready.name)
        out.append(ready)
    return out
