"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.llm.common import cut

_MAX_ROUNDS = 60


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    near = _both_ways(e)
    # Cut, so that the join has plain exchanges on both sides, which may split a vertex of huge degree.
    low = cut(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return near.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    linked = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> (node, label): label is the least node reachable. Nodes without edges are absent.

    Every vertex ends up pointing at the least vertex of its component. Only counts
    and one checksum reach the driver; each round is checkpointed. A vertex of huge
    degree is one row on the aggregated side of each join, so a skewed join splits.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, seen = cut(e), None
    for _ in range(_MAX_ROUNDS):
        e = cut(_small_star(_large_star(e)))
        # Summed as decimals: a checksum must not overflow.
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
