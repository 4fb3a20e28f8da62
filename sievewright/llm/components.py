"""Connected components of an edge table, by alternating star steps.

Each round sends every neighbour of a node to the smallest known node around
it, first outwards (large star) and then inwards (small star); the number of
rounds grows with the logarithm of the longest path.  Every step is an
aggregation and a join on edges, so no component is ever gathered in one
place, and each round is written to the scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """edges have u > v"""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Every node either points at one root or is a root that points nowhere."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    bad = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up = 1 and root = 1)")
    return bad.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of any integer kind to (node, root): nodes with edges, root the smallest node.

    Loops and repeated edges don't matter; no edges, no rows.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = stash(e, "cc")
    while not _is_stars(e):
        e = stash(_small(_large(e)), "cc")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
