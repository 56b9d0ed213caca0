"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(low, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has an edge.

    edges: a, b of one comparable type, in any order; self-loops and nulls are ignored. Every round is written to the
    shared folder, so the plan stays short and a lost executor costs one round at most. Rounds grow with the logarithm
    of the longest path.
    """
    now = stored(edges.where("a <> b").select("a", "b").distinct(), name)
    before = None
    while True:
        now = stored(_small_star(_large_star(now)), name)
        count, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (count, total) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (count, total)
