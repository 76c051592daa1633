"""Order, pages, cursors, facets, budgets and guards over results."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, top_dir

ORDER = ("path", "line", "column", "match_text")


class CursorError(ValueError):
    """A cursor of another query or of results that have changed."""


def ordered(results: DataFrame) -> DataFrame:
    return results.orderBy(*(c for c in ORDER if c in results.columns))


def page(results: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows [offset, offset + limit) in canonical order; limit 0 is no limit. A top-k for each page: only offset + limit rows leave a task."""
    out = ordered(results)
    out = out.limit(offset + limit) if limit else out
    return out.offset(offset) if offset else out


def result_mark(results: DataFrame) -> tuple[str, int]:
    """(a digest of a result set in any order, its number of rows) in one job: two sums of row hashes and the count."""
    h = [F.col(c).cast("string") for c in sorted(results.columns)]
    row = results.agg(F.sum(F.xxhash64(*h).cast("decimal(38,0)")), F.sum(F.hash(*h).cast("decimal(38,0)")), F.count("*")).first()
    return hashlib.sha256(repr(tuple(map(str, row))).encode()).hexdigest(), row[2]


def cursor(scope: dict, results: str, offset: int) -> str:
    """v1:<scope and results>:<offset>; the scope holds the limit too."""
    mark = hashlib.sha256(json.dumps(scope, sort_keys=True).encode() + results.encode()).hexdigest()[:24]
    return f"v1:{mark}:{offset}"


def cursor_offset(given: str | None, scope: dict, results: str) -> int:
    if given is None:
        return 0
    parts = given.split(":")
    if len(parts) != 3 or parts[0] != "v1" or not parts[2].isdigit():
        raise CursorError("malformed cursor")
    if cursor(scope, results, int(parts[2])) != given:
        raise CursorError("the cursor belongs to another query or to results that have changed")
    return int(parts[2])


def facets(results: DataFrame) -> DataFrame:
    """dim, value, n over all results, nulls left out: language, top directory, file type, producer, reliability, as far as there are such columns."""
    dims = {"topDir": top_dir(F.col("path")), "fileType": F.when(extension(F.col("path")) == "", "none").otherwise(extension(F.col("path")))}
    dims |= {c: F.col(c) for c in ("language", "producer", "reliability") if c in results.columns}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("dim"), v.cast("string").alias("value")) for k, v in dims.items()))).alias("f")
    return results.select(pairs).where("f.value is not null").groupBy("f.dim", "f.value").agg(F.count("*").alias("n"))


def ambiguity(definitions: DataFrame, name: str | None = None) -> DataFrame:
    """name, dim, value, n of definitions whose name several have: by language, kind, top directory and container, as far as there are such columns. Of one name, or of all."""
    own = definitions if name is None else definitions.where(F.col("name") == name)
    dims = {c: F.col(c).cast("string") for c in ("language", "kind", "container") if c in definitions.columns}
    dims |= {"topDir": top_dir(F.col("path"))} if "path" in definitions.columns else {}
    shared = own.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    pairs = F.array(*(F.struct(F.lit(k).alias("dim"), v.alias("value")) for k, v in dims.items()))
    each = own.join(shared, "name", "left_semi").select("name", F.explode(pairs).alias("f")).where("f.value is not null")
    return each.groupBy("name", "f.dim", "f.value").agg(F.count("*").alias("n"))


def preview_chars(files: int, size: int, hits: int) -> int:
    """How long previews may be, by the tree's size and the number of hits."""
    if files > 200 or size > 5 << 20 or hits > 100:
        return 96
    return 160 if files > 20 or size > 512 << 10 or hits > 50 else 240


def preview_chars_col(files: Column, size: Column, hits: Column) -> Column:
    return F.when((files > 200) | (size > 5 << 20) | (hits > 100), 96).when((files > 20) | (size > 512 << 10) | (hits > 50), 160).otherwise(240).cast("long")


#: Rows that a guarded query shows.
GUARD_SAMPLE = 5


@dataclass
class Page:
    """What a verb returns: a lazy page of results, whether there is more, and what was noticed."""

    results: DataFrame
    total: int = 0
    truncated: bool = False
    next_cursor: str | None = None
    facets: DataFrame | None = None
    guard: str | None = None
    matched_files: int | None = None
    caveats: list[str] = field(default_factory=list)

    @property
    def exit_code(self) -> int:
        return 0 if self.total else 2


def paginate(results: DataFrame, scope: dict, limit: int = 100, given: str | None = None, guard: str | None = None, allow_broad: bool = False) -> Page:
    """Facets and the total are of all results. A guarded query with more than five shows five and no cursor, whatever the limit."""
    mark, total = result_mark(results)
    if guard and not allow_broad and total > GUARD_SAMPLE:
        files = results.select("path").distinct().count()
        return Page(page(results, 0, GUARD_SAMPLE), total, True, None, facets(results), guard, files, [guard])
    scope = scope | {"limit": limit, "allow_broad": allow_broad}
    at = min(cursor_offset(given, scope, mark), total)
    end = total if limit == 0 else min(total, at + limit)
    more = limit > 0 and end < total
    return Page(page(results, at, limit), total, more, cursor(scope, mark, end) if more else None, facets(results), None, None, ["truncated"] if more else [])
