"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.storage import drop, kept


def _canonical(edges: DataFrame, u: str, v: str) -> DataFrame:
    return edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()


def _least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """The least neighbour of each node, written first, so that a hub's rows can be split in the join that follows."""
    return kept(edges.groupBy(node).agg(F.min(other).alias("least")), "least")


def _tangled(edges: DataFrame) -> bool:
    """Whether some node hangs on two others, or on one that hangs on another itself."""
    hanging = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = hanging.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 OR up = 1 AND down = 1").agg(F.count("*")).first()[0] > 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b); component is the least node reachable.

    Union-find as large-star and small-star rounds: each round hangs a node's neighbours
    on the least of them, and a logarithmic number of rounds leaves stars, where it ends. Nothing
    is collected but one number a round. Nulls and loops are no edges; nodes without an
    edge do not appear.
    """
    now = kept(_canonical(edges.where("a IS NOT NULL AND b IS NOT NULL"), "a", "b"), "edges")
    while _tangled(now):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = _least(both, "u", "v")
        large = both.join(nearest, "u").where("v > u").select("v", F.least("u", "least").alias("w"))
        large = kept(_canonical(large, "v", "w"), "large")
        lowest = _least(large, "u", "v")
        near = large.join(lowest, "u")
        small = near.select(F.col("v").alias("a"), F.col("least").alias("b")).unionByName(near.select(F.col("u").alias("a"), F.col("least").alias("b")))
        after = kept(_canonical(small, "a", "b"), "edges")
        drop(now, nearest, large, lowest)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
