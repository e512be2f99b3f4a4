"""Connected components of an edge table by alternating stars; every round is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.session import stage

ROUNDS = 100


def _pairs(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node ``v`` to the smaller ``u``."""
    return edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v > u").distinct()


def _large_star(pairs: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the least node around it."""
    both = pairs.select(F.col("v").alias("x"), F.col("u").alias("y")).union(
        pairs.select(F.col("u").alias("x"), F.col("v").alias("y"))
    )
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.join(least, "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v > u")


def _small_star(pairs: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the least of them."""
    least = pairs.groupBy("v").agg(F.min("u").alias("m"))
    moved = pairs.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return moved.union(least.select("v", F.col("m").alias("u"))).where("v > u").distinct()


def _settled(pairs: DataFrame) -> bool:
    """Whether the edges are stars: no node has two smaller neighbours, and none is both end and centre.

    The steps keep what is connected, so stars are the components.
    """
    sides = pairs.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n")).union(
        pairs.select(F.col("u").alias("node")).distinct().select("node", F.lit(1).cast("long"))
    )
    return sides.groupBy("node").agg(F.sum("n").alias("n")).where("n > 1").isEmpty()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node it is connected with."""
    pairs = stage(_pairs(edges), f"{name}-pairs")
    for _ in range(ROUNDS):
        if _settled(pairs):
            break
        pairs = stage(_small_star(_large_star(pairs)), f"{name}-round")
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
