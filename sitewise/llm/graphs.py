"""Connected components by alternating stars, one small job per round."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.session import settle


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): the smallest node that each linked node can reach. Nodes without links are not returned.

    Every round hangs neighbours onto the smallest node seen so far; groups are never collected: the smallest
    neighbour comes from an aggregate, and edges are joined back to it. Rounds grow with the logarithm of the
    longest path. Null nodes and links of a node with itself are ignored.
    """
    edges = settle(links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
                   .where("a <> b").distinct())
    before = None
    while True:
        # larger neighbours of a node hang onto its smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # smaller neighbours, and the node itself, hang onto the smallest of them
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b")))
        edges = settle(small.where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
