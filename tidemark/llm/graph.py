"""Connected components by star rounds: each round is a few joins, and every round's edges are a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import written


def _to_min(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node, label: label is the least node reachable over edges (a, b).  Nodes without an edge don't appear."""
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Large star: every larger neighbour goes to the least of the neighbourhood.
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = _to_min(both).where("v > u AND m <> v").select(F.col("m").alias("a"), F.col("v").alias("b"))
        # Small star: every smaller or equal neighbour goes to the least.
        down = _to_min(large.select(F.col("b").alias("u"), F.col("a").alias("v")))
        small = down.select(F.col("m").alias("a"), F.col("v").alias("b")).union(down.select("m", "u"))
        now = written(small.where("a <> b").distinct(), "edges")
        # Done when every node is either a centre or hangs on one centre.
        roles = now.select(F.col("a").alias("x"), F.lit(0).alias("leaf")).distinct().union(now.select("b", F.lit(1)))
        if roles.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
    labels = now.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return labels.union(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
