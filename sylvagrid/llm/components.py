"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvagrid.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest one (the node itself included)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    low = low.select("node", F.least("node", "low").alias("low"))
    return both.join(low, F.col("a") == F.col("node")).where(F.col("b") > F.col("a")).select(F.col("low").alias("a"), "b").where(F.col("a") != F.col("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    low = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("low"))
    tied = edges.join(low, F.col("b") == F.col("node")).where(F.col("a") != F.col("low")).select(F.col("low").alias("a"), F.col("a").alias("b"))
    return tied.unionByName(low.select(F.col("low").alias("a"), F.col("node").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): the root is the smallest node that links reach.

    Each step is staged, so lineage stays short; only counts and one sum reach the driver.
    The loop ends when the edges are stars around their roots, which no step changes.
    """
    ordered = links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = stage(ordered.distinct(), "edges")
    seen = None
    while True:
        edges = stage(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
