"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, remove


def _large(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours with the smallest vertex it sees."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself with the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns id, root for each vertex that isn't the smallest of its component.

    Loops, repeated edges and edges with a null end count for nothing. Rounds are cut in the shared folder,
    and the number of rounds grows with the logarithm of the longest path.
    """
    proper = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    now, before = cut(proper, "cc"), None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before, old = mark, now
        now = cut(_small(_large(old)), "cc")
        remove(old)
