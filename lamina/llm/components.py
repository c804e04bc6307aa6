"""Connected components by alternating stars: edges are drawn to ever smaller neighbours until each component is one star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import path_of, remove, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge other than a loop has; component is the smallest node reachable.

    Edges are undirected; repeated ones and loops are allowed; those with a null end are left out. Each round is a few shuffles of no more edges than there were, and is written to the
    shared folder, so a lost executor repeats at most a round. Rounds: about the square of the logarithm of the longest path."""
    spark = edges.sparkSession
    now = stored(edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum((F.xxhash64("hi", "lo") % 1_000_000_007)).alias("h")).first()
        if state == mark or not state.n:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select(F.col("lo"), F.col("lo")).distinct())
        mark = state
        after = stored(_small_star(_large_star(now)), "edges")
        if now.inputFiles():
            remove(spark, path_of(now))
        now = after
