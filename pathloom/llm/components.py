"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

MOST_ROUNDS = 50


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
    moved = edges.join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): each node of edges but the least of its component, and that least node.

    edges has bigint columns a and b in any order, repeats and loops allowed. Each round joins a node
    with the least of its neighbours; no list of neighbours is ever built, so a node may have any
    number. Rounds end when nothing changes.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        edges = checkpointed(_small(checkpointed(_large(edges))))
        before, state = state, _state(edges)
        if state == before:
            return edges
    raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
