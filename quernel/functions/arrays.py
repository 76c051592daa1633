"""Array expressions that Spark has no function for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that prefix_sums() adds up one by one; blocks of so many are summed first.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value bound once, however often and in whatever lambdas the body uses it."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(values: Column) -> Column:
    """For each element of an array of numbers the sum of those before it. Sums of blocks come first, so the work is a constant for each element and not its place."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def within(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        starts = F.aggregate(blocks, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        place = lambda k: F.floor(k / BLOCK).cast("int")
        return let(starts, lambda s: F.transform(v, lambda x, k: F.get(s, place(k)) + total(F.slice(v, place(k) * BLOCK + 1, k - place(k) * BLOCK))))

    return let(values, lambda v: F.when(F.size(v) > 0, within(v)).otherwise(F.array().cast("array<bigint>")))
