"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregate and a join over edges; every round is a written table, and only a count of changes reaches the
driver. A node with many neighbours costs a row per neighbour, never a pair of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour larger than a node is tied to the smallest of the node and its neighbours."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. ``edges`` has a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    tied = edges.join(least, "b")
    return tied.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and component (its smallest node) for every node of ``edges`` (a, b); pairs of a node with itself are ignored."""
    now = scratch.put(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        stars = scratch.put(_small_star(_large_star(now)), "edges")
        # Settled when every right end has one left end, and no left end is a right end too.
        unsettled = stars.groupBy("b").count().where("count > 1").limit(1).count() or stars.join(stars.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        scratch.drop(now)
        now = stars
        if not unsettled:
            break
    roots = now.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
