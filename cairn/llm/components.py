"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import checkpoint


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest v of each u."""
    low = edges.groupBy(F.bitwise_not("u").alias("w")).agg(F.min("v").alias("m"))
    return low.select(F.bitwise_not("w").alias("u"), "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id on an edge (a, b); component is the smallest id reachable.

    Each step is a map-side combined minimum by node and a join back, so a hub's edges are never in one group. Minima are
    grouped by the inverted node, so that the join shuffles both its sides: only such a join's hot partitions are split by
    adaptive execution. Every step's edges are checkpointed; only whether all are stars by now reaches the driver. An empty edge table gives an empty result; loops (a, a) give (a, a).
    """
    e = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _flat(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter(F.col("u") > F.col("v")).distinct()
        low = _lowest(down)
        kept = down.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(kept.unionByName(low.select("u", F.col("m").alias("v"))).filter(F.col("u") > F.col("v")).distinct())
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    return ids.join(e.filter("u > v").select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def _flat(e: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and none if it is itself one."""
    one, zero = F.lit(1), F.lit(0)
    ends = e.filter("u > v").select(F.col("u").alias("x"), one.alias("up"), zero.alias("down"))
    ends = ends.unionByName(e.filter("u > v").select(F.col("v").alias("x"), zero.alias("up"), one.alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty()
