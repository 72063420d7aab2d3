"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalis.session import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connects the neighbours of each node to the smallest of them.

    The large star moves neighbours above the node, the small star the node and those below it.
    The smallest neighbour is an aggregate, so that a node with very many links is only
    summed; its rows are joined with one row, which Spark splits when they are too many.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(low, "a").select("b", "m").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """If every node has one edge to a smaller one at most, and none if it is the smaller end of another."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame, label: str = "components", known: DataFrame | None = None) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long, a <> b); the component is its smallest node.

    ``known`` are components found before, which go on from there: their nodes are in the result,
    too. Rounds go on until the edges are stars around the smallest nodes; every round is
    written to the shared folder. Empty links give an empty table.
    """
    if known is not None:
        links = links.select("a", "b").unionByName(known.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while not _settled(edges):
        edges = staged(_star(_star(edges, True), False), label)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
