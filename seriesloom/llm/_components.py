"""Connected components of a graph held in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import checkpointed, discard, spread_join


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour, or the node."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return spread_join(both.where("v > u"), low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = spread_join(down, low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v), but for the roots; the root is a component's smallest node.

    Rounds go on until nothing changes, about the logarithm of the longest chain. Each is stored in the
    checkpoint folder in place of the one before. Node sets stay distributed; the driver sees counts.
    """
    now = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    sign = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if new == sign:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out.stored_in = now.stored_in
            return out
        sign, before = new, now
        now = checkpointed(small_star(large_star(before)))
        discard(before)
