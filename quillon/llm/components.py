"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a group-by minimum and an equi-join; nothing is collected, a hub's edges are
pre-aggregated or split by adaptive execution, and every round is written to the shared
scratch folder. The loop ends when a round leaves the edge set unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges``: u > v in every row."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges(a, b)`` of longs to (node, label): the least node reachable; nodes without edges are left out."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, "cc-start")
    mark = _mark(now)
    for _ in range(max_rounds):
        now = materialize(_small_star(_large_star(now)), "cc-round")
        if (new := _mark(now)) == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
