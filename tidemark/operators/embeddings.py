"""Operators on embedding tables joined to lists and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance


def mean_vector(df: DataFrame, key: str, vector: str, weight: Column | None = None, name: str = "vector") -> DataFrame:
    """The mean per dimension of a key's (weighted) vectors; one partial sum per key, task and dimension is shuffled."""
    x = df.select(key, F.posexplode(vector).alias("pos", "x"), (weight if weight is not None else F.lit(1.0)).alias("w"))
    m = x.groupBy(key, "pos").agg(F.avg(F.col("x") * F.col("w")).alias("x"))
    return m.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("s")).select(key, F.col("s.x").alias(name))


def pair_distances(lists: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """V8: (key, a, b, distance) for the pairs of each list; lists are short by nature (a shown page)."""
    v = lists.join(vectors.select("article", "vector"), "article")
    a = v.select(key, F.col("article").alias("a"), F.col("vector").alias("va"))
    b = v.select(key, F.col("article").alias("b"), F.col("vector").alias("vb"))
    return a.join(b, key).where("a < b").select(key, "a", "b", cosine_distance("va", "vb").alias("distance"))
