"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for nodes with an edge.

    Alternates large-star and small-star steps until the edges are a star
    around each component's smallest node: O(log^2 n) rounds, a few rows an
    edge in each. Every round's edges are written to the shared folder, so a
    lost executor costs one round at most. Stars are formed by a grouped
    minimum and a join on it (no neighbour lists), so a hot node is not
    gathered anywhere. Self-loops and repeated edges are ignored; nulls drop.
    """
    def undirected(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def is_stars(e: DataFrame) -> bool:
        """No node has two smaller ones, or both a smaller and a larger one."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return ends.filter("up > 1 or up + down > 1").isEmpty()

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    e = materialize(e, "cc")
    while not is_stars(e):
        # large star: every larger neighbour of u moves to u's smallest neighbour
        both = undirected(e)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = materialize(least, "cc")  # joins of two scans can be split by AQE where a node is hot
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        large = materialize(large, "cc")
        # small star: u and its smaller neighbours move to the smallest of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "cc")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
