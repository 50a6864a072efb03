"""Connected components of an edge table, by alternating star contraction on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import common


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges (a, b): component is the least reachable node.

    Large-star links each node's larger neighbours to its least neighbour; small-star links its
    smaller ones. Both are one min-aggregate and one join, and only pairs travel: no group is ever
    gathered. Rounds go on until the edges stay the same; the number of rounds grows with the
    logarithm of the longest chain.
    """
    edges = common.checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # large star: from every node, larger neighbours point to the least of the neighbourhood
        ways = _both_ways(edges)
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: smaller neighbours and the node itself point to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b") \
            .unionByName(least.select("a", F.col("m").alias("b")))
        edges = common.checkpointed(small.distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) \
                .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
