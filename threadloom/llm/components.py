"""Connected components of links between 64-bit nodes, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sources.scratch import cut_lineage


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest, to see whether a round changed anything."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours link to the smallest of its neighbourhood.
    Small star: each node and its smaller neighbours do."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    linked = both.join(least, "a")
    out = (
        linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        if large
        else linked.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(linked.select("a", F.col("least").alias("b")))
    )
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node reachable; roots have no row.

    Alternating large-star and small-star rounds; each round is checkpointed and the loop ends when a round
    changes nothing.  The least neighbour is combined before the shuffle, so the centre of a star is not one task's
    list.  Self links and repeated links are allowed, NULL ends are left out.
    """
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(edges)
    while before[0]:
        edges = cut_lineage(_star(_star(edges, large=True), large=False))
        now = _mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
