"""Functions on arrays of doubles as vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.when(size.isNotNull(), F.lit(0.0)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """F34."""
    return 1 - cosine(a, b)


def scaled(a: Column | str, k: Column) -> Column:
    return F.transform(_c(a), lambda x: x * k)


def unit(a: Column | str) -> Column:
    """V / (|v| + 1e-6)."""
    size = norm(a) + 1e-6
    return F.transform(_c(a), lambda x: x / size)
