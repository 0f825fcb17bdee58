"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of two or three numbers up to which a written table is broadcast; beyond it joins shuffle.
SMALL_ROWS = 200_000


def sized(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast only if it has few rows."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` (a, b) to (node, component): the smallest node reachable, for every node in a link.

    Each round replaces every link by one to the least neighbour; the links of a component become a
    star.  Nothing is gathered by key: minima are pre-aggregated, and a hub's links are rows of a
    join that the engine may split.
    """
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        large = _star(edges, True, scratch)
        small = _star(large, False, scratch)
        same = edges.count() == small.count() and edges.join(small, ["a", "b"], "left_anti").isEmpty()
        scratch.drop(edges, large)
        edges = small
        if same:
            break
    return scratch.keep(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct(), "labels")


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Edges have a > b.  Large: each neighbour above a node moves to the node's least neighbour (or
    itself).  Small: each neighbour below it, and the node itself, move to the least one."""
    own = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        own = own.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = scratch.keep(own.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")), "least")
    joined = own.join(sized(least), "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
    else:
        moved = joined.select(F.col("v").alias("x"), F.col("m").alias("y")).unionByName(joined.select(F.col("u").alias("x"), F.col("m").alias("y")))
    out = scratch.keep(moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    scratch.drop(least)
    return out
