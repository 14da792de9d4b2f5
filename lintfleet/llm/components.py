"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintfleet.session import materialize

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of `links` (a, b): the label is the smallest node reachable.

    Each round hangs all larger neighbours of a node below its smallest one, then all smaller ones. Rows stay bounded
    by the links; rounds grow with the logarithm of the longest path. A node with very many links is safe: its rows
    are only reduced to a minimum before the shuffle and joined back as a large side that can be split.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small step: a node's smaller neighbours, and the node itself, go below the smallest of them
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        new = materialize(small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), "links")
        if new.join(edges, ["a", "b"], "left_anti").isEmpty() and edges.join(new, ["a", "b"], "left_anti").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                new.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        edges = new
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
