"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = _both_ways(edges)
    least = common.materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = common.materialize(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """a, b: the least node b that each node a of the edges (a, b) reaches, where that is another one.

    Each round writes its edges to the shared folder; they shrink to stars.  Least neighbours are partial
    aggregates, written before the join, so that both of its sides are dealt for the join alone: a hub's
    edges meet one row of the other side, and Spark broadcasts that side or splits the hub as a skewed key.
    """
    current = common.materialize(edges.where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        current = common.materialize(_small_star(_large_star(current)).where("a <> b").distinct(), "stars")
        found = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if found == mark:
            return current
        mark = found
    raise RuntimeError("components did not settle")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the least node that each node of the edges (a, b) reaches."""
    found = stars(edges, most_rounds)
    return found.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
