"""Connected components of an edge table by alternating stars; every round is a few joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _sketch(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; the root is the smallest node that can be reached.

    A large star hangs the larger neighbours of a node on the smallest one, a small star the smaller ones; both keep
    components and bring every tree to depth one in a number of rounds that grows with the logarithm of its size. The
    neighbours of a node are never gathered: the minimum is combined before the shuffle and joined back. Rounds end in
    stored tables. Self-loops and nulls are dropped; an empty edge table gives an empty result.
    """
    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _sketch(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
        least = stored(least, "least")  # a table on both sides of the join lets Spark split a node of many edges
        large = (both.join(least, both.a == least.u).where("b > a and b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = stored(large, "large-star")
        least = stored(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
        hung = large.join(least, large.a == least.u).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(hung.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "small-star")
        now = _sketch(edges)
        if now == before:
            break
        before = now
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(edges.select("b", "b").distinct()))
