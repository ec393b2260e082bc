"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.storage import saved


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with m, the least node of u.

    The key is u's complement: the minima were grouped by u, so both sides are shuffled for this join and nothing else,
    and the adaptive skew join can split the edges of a hub, which the smallest node of a component becomes.
    """
    return edges.withColumn("other", F.bitwise_not("u")).join(least.select(F.bitwise_not("u").alias("other"), "m"), "other").drop("other")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(edges, least).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge table: two sums of numbers, two rows on the driver."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(0x7FFFFFFF)), F.sum(F.shiftright(h, 33))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node long, root long) for every node of ``edges`` (u long, v long): root is the smallest node it reaches.

    Both stars keep the components and never make more edges than they got, so a round's size is that of the
    input; the number of rounds grows with the logarithm of the longest path. Each round is cut off by a
    checkpoint. Self loops, repeated edges and either direction are allowed; rows with a null end are ignored; an
    empty table gives an empty result.
    """
    tidy = edges.where("u is not null and v is not null")
    nodes = saved(tidy.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now, before = saved(nodes.where("u != v")), None
    while (state := _state(now)) != before:
        before = state
        now = saved(_small_star(_large_star(now)))
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    alone = nodes.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    return ends.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("root").alias("root"))
