"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weir.llm.common import pinned, shuffled


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every end of ``links(a, b)``, two longs; ``component`` is the smallest
    node that links lead to.

    Alternating stars: each node hands its larger neighbours to its smallest one, then its smaller
    neighbours.  A round is two aggregates with map-side combine and two joins, whose hot nodes
    adaptive execution splits; only one digest row comes to the driver, and no side of a join is broadcast.  Each round is written to the
    shared folder, so lost executors cost no more than the round.  NULL ends and self-links are left out.
    """
    edges = pinned(_ordered(links), "links")
    before = _digest(edges)
    while True:
        edges = pinned(_small_star(_large_star(edges)), "links")
        after = _digest(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select("b", "b")).distinct()
        before = after


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, from its larger end ``a`` to its smaller end ``b``."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(
        "a <> b").distinct()


def _digest(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    larger = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))     # neighbours above a node
    return larger.join(shuffled(least), "a").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    edges = edges.distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(shuffled(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(moved.union(least.select("a", F.col("m").alias("b"))))
