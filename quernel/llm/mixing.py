"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, stage, word_count

#: Weights of the sources in code point order, repeating; the share of all sizes that the mix takes; the most epochs of a source.
WEIGHTS, SHARE, MOST_EPOCHS = (5, 2, 1), 1.5, 2
#: A source's keys are dealt to so many ranges; only the range that holds the cut is ever ordered.
RANGES = 4096
#: Goes before the names of columns that are only carried along, so that they clash with none.
_KEPT = "kept_"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target for a table (source, source_size) with a row for each source.

    Targets are weight x level, at most `most` times the source's size, and sum to share x all sizes. That level is what repeated
    resharing of the excess ends at: with sources by falling need (most x size / weight), it is the first level at which no later source is full; levels fall from there on.
    One row for each source passes through the windows, none for each document.
    """
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = (
        sizes.withColumn("w", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("room", F.col("cap") / F.col("w"))
        .withColumn("budget", F.sum("source_size").over(every) * share)
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("double")))
        .withColumn("w_from", F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("w_from"))
    )
    level = F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(every)
    target = F.when(level.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("w") * level))
    return full.select("source", "source_size", target.cast("double").alias("target"))


def sampling_key(doc_id: Column, quality: Column, seed: str) -> Column:
    """-ln(u) / quality with u in (0, 1) drawn from a hash of the document's id: reruns agree, and higher quality comes first more often."""
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 12), 16, 10).cast("double")
    return -F.log((draw + 0.5) / float(1 << 48)) / quality


def mix(docs: DataFrame, labels: DataFrame | None = None, *, seed: str = "mix:", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs (complete copies taken), then the columns named in keep.

    A source takes floor(target / source_size) complete epochs; what is left of the target goes to its documents by ascending key, summed until
    it is spent, so the last document gives only its first words. Null text has size 0; such documents and those of an empty source take 0.
    Null sources form one source, the last. Equal ids have equal keys and go in order of size. labels (doc_id, quality 0 or 1; repeated rows are averaged) scales
    the keys from 0.5 to 2; without a label a document weighs 1. An empty table gives an empty result.
    A source's documents are never gathered: sizes are summed by (source, key range) first, and only the range with the cut is ordered. Words are counted in one scan, which leaves a
    slim table.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *(F.col(c).alias(_KEPT + c) for c in keep))
    if labels is not None:
        rated = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("q"))
        base = base.join(rated, "doc_id", "left").withColumn("quality", F.when(F.col("q").isNull(), 1.0).otherwise(0.5 + 1.5 * F.col("q"))).drop("q")
    else:
        base = base.withColumn("quality", F.lit(1.0))
    base = base.withColumn("key", sampling_key(F.col("doc_id"), F.col("quality"), seed))
    base = stage(base.withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key"))) * RANGES), F.lit(RANGES - 1)).cast("int")), "mix-sizes")

    ranges = base.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    sources = source_targets(ranges.groupBy("source").agg(F.sum("in_range").alias("source_size")), weights, share, most)
    sources = sources.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.round(F.col("target") - F.col("rounds") * F.col("source_size")).cast("long"))
    before = F.sum("in_range").over(Window.partitionBy("source").orderBy("range")) - F.col("in_range")
    placed = ranges.withColumn("before", before).join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ends = F.col("before") + F.col("in_range")
    cuts = placed.groupBy(F.col("source").alias("s"), "source_size", "target", "rounds", "rest").agg(
        F.coalesce(F.max(F.when(ends <= F.col("rest"), F.col("range"))), F.lit(-1)).alias("last"),
        F.max(F.when((F.col("before") < F.col("rest")) & (F.col("rest") < ends), F.struct("range", "before"))).alias("cut"),
    )  # a row for each source

    joined = base.join(cuts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at_cut = F.coalesce(F.col("range") == F.col("cut.range"), F.lit(False))
    whole = joined.where(~at_cut).withColumn("more", F.when(F.col("range") <= F.col("last"), F.col("size")).otherwise(0).cast("long"))
    ahead = F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    cut = joined.where(at_cut).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("cut.before") - ahead)).cast("long"))
    taken = (F.col("rounds") * F.col("size") + F.col("more")).cast("long").alias("taken")
    return whole.unionByName(cut).select("doc_id", "size", "source_size", "target", taken, F.col("rounds").alias("epochs"), *(F.col(_KEPT + c).alias(c) for c in keep))


def first_words(text: str, n: int) -> str:
    """text up to the end of its n-th word."""
    end = 0
    for m in islice(re.finditer(WORD, text), n):
        end = m.end()
    return text[:end]


def mixed(docs: DataFrame, labels: DataFrame | None = None, **how) -> DataFrame:
    """The mix itself, with the columns of docs: each document once for every complete epoch, once more if the fraction takes it, and the last one of a
    source cut after the words that were left. Documents that aren't taken, and those without words, go."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, counts: pa.Array) -> pa.Array:
        return pa.array([first_words(t.as_py(), n) for t, n in zip(texts, counts.to_pylist(), strict=True)], pa.string())

    columns = docs.columns
    alike = lambda doc, source, size: F.struct(F.col(doc).cast("long").alias("a"), F.col(source).cast("string").alias("b"), size.alias("c"))  # noqa: E731  nulls are equal in it
    row, key, place = (fresh(n, columns) for n in ("n_row", "row_key", "row_place"))
    chosen = mix(docs, labels, keep=("source",), **how)
    more = F.col("taken") - F.col("epochs") * F.col("size")
    # Rows alike in id, source and size are interchangeable: some of them are taken whole once more, one in part.
    plan = chosen.where("size > 0").groupBy(alike("doc_id", "source", F.col("size")).alias("k")).agg(F.max("epochs").alias("epochs"), F.count_if(more == F.col("size")).alias("whole"), F.max(F.when(more < F.col("size"), more)).alias("part"))
    plan = plan.where("epochs > 0 or whole > 0 or part > 0")
    rows = docs.select(F.struct(*columns).alias(row), alike("doc_id", "source", word_count(F.col("text"))).alias(key)).join(plan, F.col(key) == F.col("k"))  # texts move once
    placed = rows.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.col(f"{row}.text"))))
    copies = (F.col("epochs") + F.when(F.col(place) <= F.col("whole"), 1).otherwise(0)).cast("int")
    words = F.when((F.col(place) == F.col("whole") + 1) & (F.col("part") > 0), F.col("part"))
    each = F.explode(F.concat(F.array_repeat(F.lit(None).cast("long"), copies), F.when(words.isNotNull(), F.array(words)).otherwise(F.array().cast("array<long>")))).alias(place)
    taken = placed.select(row, each).select(f"{row}.*", F.col(place).alias(_KEPT))
    whole, part = taken.where(F.col(_KEPT).isNull()).drop(_KEPT), taken.where(F.col(_KEPT).isNotNull())
    part = part.withColumn("text", cut(F.col("text"), F.col(_KEPT))).drop(_KEPT)
    if "n_chars" in columns:
        part = part.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return whole.unionByName(part.select(*columns))
