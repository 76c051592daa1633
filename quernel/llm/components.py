"""Connected components of a graph that no machine holds, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _toward_least(pairs: DataFrame, made: list[DataFrame]) -> DataFrame:
    """(u, v) with the least of u and its neighbours v in `least`. The least ones are written first, so both sides of the join are plain exchanges and a node with very many
    neighbours is split over tasks by the adaptive skew join. What is written is added to `made`."""
    least = stage(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("least")), "least")
    made.append(least)
    return pairs.join(least, "u")


def large_star(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Each node's larger neighbours go to the least of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _toward_least(both, made).where("v > u").select(F.col("least").alias("u"), "v").where("u < v").distinct()


def small_star(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them."""
    down = _toward_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), made)
    return down.select(F.col("least").alias("u"), F.col("v")).unionByName(down.select(F.col("least").alias("u"), F.col("u").alias("v"))).where("u < v").distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component): for each node of the edges (u, v) the least node that it reaches. Nodes without an edge don't appear.

    Every round writes its edges to the shared folder. It ends when every larger end has one smaller end, which has none itself; only counts reach the driver.
    """
    now = stage(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "edges")
    for _ in range(most_rounds):
        if now.isEmpty():
            break
        ends = now.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        if ends.isEmpty() and now.select("v").join(now.select(F.col("u").alias("v")), "v", "left_semi").limit(1).isEmpty():
            break
        made = [now]
        large = stage(large_star(now, made), "edges")
        now = stage(small_star(large, made), "edges")
        for table in [large, *made]:
            unstage(table)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
