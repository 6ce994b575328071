"""Null-aware scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_of(*cols: Column) -> Column:
    """nulls count as 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in cols))


def mean_of(*cols: Column) -> Column:
    """mean of those that are not null."""
    known = reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in cols))
    return F.try_divide(sum_of(*cols), known)


def finite(x: Column) -> Column:
    """Infinite and NaN become null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def rescale(x: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """F38."""
    return to_low + F.try_divide(x - low, high - low) * (to_high - to_low)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def gain_weight(scroll: Column) -> Column:
    """Null is 0, a hundredth, at least 0.1."""
    return F.greatest(F.coalesce(scroll, F.lit(0.0)) / 100, F.lit(0.1))
