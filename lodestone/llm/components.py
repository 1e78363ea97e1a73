"""Connected components of links that may be any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least.select("a", "m")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node) of every node of ``links`` (a, b long).

    Large-star and small-star steps alternate until every node points at the least of
    its component; each round is written to the shared folder. Nothing is
    collected, and a hub's links are only summed, never gathered. Links of a
    node with itself and null ends say nothing and are ignored."""
    edges = written(links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not edges.isEmpty():
        old, edges = edges, written(_small_star(_large_star(edges)), "stars")
        forget(old)
        # Done when every node has one link, to a node that has none: then stars are components.
        ends = edges.select(F.col("b").alias("a")).distinct()
        again = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
        if edges.join(ends, "a", "left_semi").select("a").union(again).isEmpty():
            break
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out._stored = edges._stored
    return out
