"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b). Large: each node's larger neighbours point to its least neighbour or itself;
    small: a node's smaller neighbours, and the node, point to the least of them."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    pairs = near.join(least.hint("merge"), "a")
    if large:
        out = pairs.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root of every node that has an edge; root is the component's least node.

    edges: a, b of an orderable type; loops and repeats do no harm. Minima are pre-aggregated
    and joined back, so a node with very many neighbours isn't gathered in one task; every
    round is written to the shared folder.
    """
    at = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = None
    for _ in range(rounds):
        at = staged(_starred(staged(_starred(at, large=True)), large=False))
        state = at.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
