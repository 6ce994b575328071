"""Connected components by alternating large-star and small-star rounds, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _tops(edges: DataFrame) -> DataFrame:
    """Per first end, the smallest id among itself and its second ends; combined map-side, so a hub costs one row a task."""
    return edges.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge in `edges` (u, v); component is the smallest id reachable.

    Loops, repeated edges and nulls are ignored. Each round is a written cut; no round holds a node's whole neighbourhood
    in one row. Rounds needed grow with the logarithm of the largest component.
    """
    now = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    now = materialize(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(limit):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_tops(both), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_tops(large), "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        before, now = now, materialize(small.distinct(), "edges")
        discard(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    tops = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
