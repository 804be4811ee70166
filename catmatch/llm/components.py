"""Connected components of a table of links, by rounds of large-star and small-star joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catmatch.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs → node, root: the smallest node that links reach; nodes without links are left out.

    Each round points every node at the smallest one known and drops repeats, so a round's
    rows never outnumber the links; rounds grow with the logarithm of the longest chain.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # Large star: neighbours above a node go to its smallest; small star: so do the ones below, and the node.
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = materialize(small.union(lowest.select("a", F.col("low").alias("b"))).filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
