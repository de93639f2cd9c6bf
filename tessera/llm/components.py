"""Connected components by alternating large-star and small-star steps: only edges and minima are shuffled, hot nodes are pre-aggregated
and the joins on them are dealt over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted, stored


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edges (a, b); nodes that only meet themselves are left out.

    Each step joins the edges, keyed by node, with that node's smallest neighbour. The number of rounds grows with the logarithm of the
    longest chain."""
    least = lambda df: df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
    low = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before = _sum(low)
    while before[0]:
        both = low.unionByName(low.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = least(both).withColumn("m", F.least("u", "m"))
        large = salted(both, mins, ["u"], "rows", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = stored(large.distinct())
        mins = least(large)
        small = salted(large, mins, ["u"], "rows", 2 * before[0]).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = stored(small.unionByName(mins.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        after = _sum(low)
        if after == before:
            break
        before = after
    stars = low.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(low.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
