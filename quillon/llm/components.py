"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, discarded, stored


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour that is greater than a node is tied to the least one of node and neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return dealt(both.filter("b > a"), least, ["a"], ["b"]).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are tied to the least of them; edges run from greater to lesser."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = dealt(edges, least, ["a"], ["b"]).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars around their least nodes: no node has two lesser neighbours, or both lesser and greater ones."""
    both = edges.select("a", F.lit(1).alias("lesser"), F.lit(0).alias("greater")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("lesser"), F.lit(1).alias("greater")))
    sums = both.groupBy("a").agg(F.sum("lesser").alias("l"), F.max("greater").alias("g"))
    return sums.filter((F.col("l") > 1) | ((F.col("l") > 0) & (F.col("g") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of the edges (a, b) that is not its own root.

    Edges to itself are dropped. Each round is written to the shared folder, and
    the one before it deleted with its shuffle files; rounds go on until the
    edges are stars, which takes about the square of the logarithm of the
    nodes' number. The test takes one aggregation, where a round takes seven exchanges.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(now):
        before = now
        now = stored(_small(_large(now)).distinct())
        discarded(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
