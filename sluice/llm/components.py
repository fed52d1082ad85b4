"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of longs -> (node, root), root the least node of its component.

    Nodes without an edge, self loops and rows with a null end give no row. Each round is a join and a
    minimum per node, so a hub's neighbours never meet in one task as a list; each round's edges are
    checkpointed in the shared folder. The number of rounds grows with the logarithm of the longest path.
    """
    shared_dir(edges.sparkSession, "cc")  # makes sure that a checkpoint folder is set
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now, before = now.checkpoint(), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        now, before = _small_star(_large_star(now)).checkpoint(), state
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(now.select("lo", "lo").distinct())
