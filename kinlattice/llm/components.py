"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, spread_join


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every a's larger neighbours move to the least of a and its neighbours."""
    side = least.select("a", F.least("a", "m").alias("m"))
    # the centre of a large star holds most rows
    return spread_join(edges, side, ["a"], "b").select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges are (a, b) with a < b: every b's smaller neighbours, and b itself, move to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(b, a): every node but the least of its component, with that least node. ``edges``: (a, b), a < b, repeats allowed.

    The edges are stars about their least nodes as soon as no node has a smaller neighbour and another one.
    """
    now, held = edges.select("a", "b"), []
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = shelf.put(both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("last")))
        if least.where("m < a AND m < last").isEmpty():
            shelf.drop(*held)
            return least.where("m < a").select(F.col("a").alias("b"), F.col("m").alias("a"))
        step = shelf.put(_large_star(now, least))
        now = shelf.put(_small_star(step))
        shelf.drop(*held, least, step)
        held = [now]
