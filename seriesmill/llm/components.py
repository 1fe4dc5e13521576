"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.session import checkpointed


def _stars(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are hung on the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))  # apart, so that the join can split a hot node
    return both.where("b > a").join(least, "a").select(F.col("low").alias("a"), "b").where("a <> b")


def _links(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, are hung on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(least, "a").select(F.col("low").alias("a"), "b").where("a <> b")
    return moved.unionByName(least.select(F.col("low").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node with an edge.

    ``edges`` has columns a and b. Rounds of two joins each; their number grows
    with the logarithm of the longest path. The smallest node of a component is
    not a row of its own. Hot nodes are joined by sort-merge joins that adaptive
    execution splits.
    """
    edges = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        new = checkpointed(_links(_stars(edges)).distinct())
        tops = new.groupBy("b").count().where("count > 1").limit(1)  # a node under two others: not yet a star
        inner = new.select("a").distinct().join(new.select(F.col("b").alias("a")), "a", "left_semi").limit(1)
        if tops.isEmpty() and inner.isEmpty():
            return new.select(F.col("b").alias("node"), F.col("a").alias("component"))
        edges = new
