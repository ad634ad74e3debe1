"""Connected components by alternating large-star and small-star contraction, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).distinct()


def _is_done(e: DataFrame) -> bool:
    """Whether edges (u, v) with v < u are stars: each u has one v, and no v is a u. Both steps leave stars, and nothing else, as they are."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """(node, root) for every node but the roots of the graph with edges (u, v); root is the component's smallest node.

    Edges must be of non-null longs; loops and repeats are ignored, an empty table gives an empty table. Each round is
    written to the shared folder, which cuts lineage; a round moves at most the edges and only minima per node, never
    a node's whole neighbourhood. The number of rounds grows with the logarithm of the longest path; edges that are stars take none.
    """
    down = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, k = scratch.cut(down, f"{name}-0"), 0
    while not _is_done(e):
        k += 1
        e = scratch.cut(_small(_large(e)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
