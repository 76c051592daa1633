"""Changes of files, folded in batch or as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import skipped_dir

FOLDED = "path string, state string, previous_path string, last_seq long"
#: Kinds of events. rename has both paths; rename_from and rename_to are its halves; touch changes a file but not its data.
KINDS = ("create", "modify", "touch", "rename", "rename_from", "rename_to", "remove")
#: What a path is after an event that settles it.
SETTLED = {"modify": "modified", "touch": "modified", "rename_from": "renamed", "remove": "deleted"}


def step(state: str | None, kind: str) -> str | None:
    """What a path is after one more event. The first event counts: created is added until its data change; created and removed cancels out; modified, deleted and renamed stay, but
    that a whole rename always counts."""
    if kind == "rename":
        return "renamed"
    if state is None:
        return "added" if kind in ("create", "rename_to") else SETTLED.get(kind)
    if state == "added":
        return "modified" if kind == "modify" else None if kind == "remove" else state
    return state


def fold(events: DataFrame) -> DataFrame:
    """path, state, previous_path, last_seq after all events (path, seq, kind, previous_path) in order of seq; paths whose events cancel out are left out.

    A path is added after the last of create, rename_to and remove was one of the first two, until an event settles it: a change of data, or, while it isn't added, any event of SETTLED.
    So one pass over a path's sorted events finds the first that settles it; its events are never gathered, and a path with very many is sorted on disk.
    """
    known = events.where(F.col("kind").isin(*KINDS))
    before = Window.partitionBy("path").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when(F.col("kind").isin("create", "rename_to"), True).when(F.col("kind") == "remove", False)
    added = F.coalesce(F.last(turn, ignorenulls=True).over(before), F.lit(False))
    settles = (F.col("kind") == "modify") | (~added & F.col("kind").isin(*SETTLED))
    became = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in SETTLED.items()))
    each = known.withColumn("settles", settles).withColumn("turn", turn).withColumn("became", became)
    order = F.struct("seq", "kind")
    whole = F.col("kind") == "rename"
    out = each.groupBy("path").agg(
        F.bool_or(whole).alias("moved"), F.max_by(F.struct("previous_path"), F.when(whole, order)).alias("back"), F.min_by("became", F.when(F.col("settles"), order)).alias("settled"),
        F.max_by("turn", F.when(F.col("turn").isNotNull(), order)).alias("last_turn"), F.max("seq").alias("last_seq"),
    )
    state = F.when(F.col("moved"), "renamed").when(F.col("settled").isNotNull(), F.col("settled")).when(F.col("last_turn"), "added")
    return out.select("path", state.alias("state"), F.col("back.previous_path").alias("previous_path"), "last_seq").where("state is not null")


def fold_stream(events: DataFrame) -> DataFrame:
    """The same over a stream, a row for each path whenever it changes. Events of a micro-batch are taken in order of seq; older ones than the last seen are ignored, so a replay
    changes nothing."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, back, last = state.get if state.exists else (None, None, -1)
        rows = pd.concat(list(batches)).sort_values(["seq", "kind"])
        for seq, kind, previous in zip(rows["seq"], rows["kind"], rows["previous_path"], strict=True):
            if seq > last:
                now, back, last = step(now, kind), previous if kind == "rename" else back, int(seq)
        state.update((now, back, last))
        yield pd.DataFrame([(key[0], now, back, last)], columns=["path", "state", "previous_path", "last_seq"])

    return events.where(F.col("kind").isin(*KINDS)).groupBy("path").applyInPandasWithState(run, FOLDED, "state string, previous_path string, last_seq long", "update", GroupStateTimeout.NoTimeout)


def drain(changes: DataFrame, folder: str) -> DataFrame:
    """Run a stream of changes until its source has no more, each micro-batch to files of its own below the folder, and return all rows that came with their batch. A batch that is run
    again replaces its files."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    changes.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return changes.sparkSession.read.schema(f"{FOLDED}, batch long").parquet(f"{folder}/rows")


def without_generated(events: DataFrame) -> DataFrame:
    """Events on paths that are worth looking at: none in generated or version control directories."""
    return events.where(~skipped_dir(F.col("path")) & ~F.array_contains(F.split("path", "/"), ".DS_Store"))


def manifest_states(events: DataFrame) -> DataFrame:
    """root_id, state of manifests, fresh at first, after their refresh events (root_id, seq, event) in order: changes of source, config or environment make one stale, a reconcile
    then makes it updating, and it is fresh once built.

    What counts is the last change, the first reconcile after it and the first build after that, so two passes over a root's sorted events do, and none is gathered.
    """
    by_root = Window.partitionBy("root_id")
    last = lambda cond: F.max(F.when(cond, F.col("seq"))).over(by_root)
    first = lambda cond: F.min(F.when(cond, F.col("seq"))).over(by_root)
    changed = events.withColumn("changed", last(F.col("event").isin("source", "config", "environment")))
    taken = changed.withColumn("taken", first((F.col("event") == "reconcile") & (F.col("seq") > F.col("changed"))))
    built = taken.groupBy("root_id").agg(F.max("changed").alias("changed"), F.max("taken").alias("taken"), F.min(F.when((F.col("event") == "built") & (F.col("seq") > F.col("taken")), F.col("seq"))).alias("built"))
    state = F.when(F.col("changed").isNull() | F.col("built").isNotNull(), "fresh").when(F.col("taken").isNotNull(), "updating").otherwise("stale")
    return built.select("root_id", state.alias("state"))


def idle_sessions(activity: DataFrame, now: int, budget: int) -> DataFrame:
    """Sessions (session, seen_at in ms) whose last activity lies `budget` ms or more back."""
    return activity.groupBy("session").agg(F.max("seen_at").alias("seen_at")).where(F.lit(now) - F.col("seen_at") >= budget)
