"""Connected components by alternating large-star and small-star steps on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsift.llm.common import staged


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """``u, m``: the least of each node and its neighbours in directed ``u, v``."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``): the least node that it reaches.

    Each step links nodes to the least node they see: first their larger
    neighbours, then their smaller ones, until nothing changes. Every step is
    written to the shared folder, so no lineage builds up; the number of steps
    grows with the logarithm of the longest chain.
    """
    edges = staged(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above a node link to the least one it sees.
        large = staged(
            both.join(_least_neighbour(both), "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # Small star: a node and its smaller neighbours link to the least of them.
        least = _least_neighbour(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(
            small.unionByName(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct(), "small-star")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
