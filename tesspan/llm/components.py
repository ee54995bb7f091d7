"""Connected components of a large edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b long.  Returns node, root for every node of an edge; root is the smallest node it reaches.

    Each round links larger neighbours, then smaller ones, to the smallest neighbour of a node.  Minima are
    combined before the shuffle, and the joins are plain inner joins that adaptive execution splits at a hub.
    """
    e = saved(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(e)
    if not before[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        e = saved(small, "small")
        after = _mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
