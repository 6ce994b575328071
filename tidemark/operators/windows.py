"""Group normalisation, ranks, statistics, and windows over rows and time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_max(x: Column | str, *by: str) -> Column:
    """X / max |x|'s signed maximum, as the reference of a group is its largest value."""
    return F.try_divide(_c(x), F.max(_c(x)).over(W.partitionBy(*by)))


def norm_sum(x: Column | str, *by: str) -> Column:
    """W2."""
    return F.try_divide(_c(x), F.sum(_c(x)).over(W.partitionBy(*by)))


def norm_l2(x: Column | str, *by: str, literal: bool = False) -> Column:
    """X / sqrt(sum x^2); the literal form leaves out the root."""
    total = F.sum(_c(x) * _c(x)).over(W.partitionBy(*by))
    return F.try_divide(_c(x), total if literal else F.sqrt(total))


def diff_median(x: Column | str, *by: str) -> Column:
    """W4."""
    return _c(x) - F.median(_c(x)).over(W.partitionBy(*by))


def diff_mean(x: Column | str, *by: str) -> Column:
    return _c(x) - F.avg(_c(x)).over(W.partitionBy(*by))


def ratio_mean(x: Column | str, *by: str) -> Column:
    """W5."""
    return F.try_divide(_c(x), F.avg(_c(x)).over(W.partitionBy(*by)))


def ratio_quantile(x: Column | str, p: float, *by: str) -> Column:
    """W5/W18."""
    return F.try_divide(_c(x), F.percentile(_c(x), p).over(W.partitionBy(*by)))


def diversity(x: Column | str, *by: str) -> Column:
    """Distinct values of the group, null counting as one."""
    w = W.partitionBy(*by)
    return (F.size(F.collect_set(_c(x)).over(w)) + F.max(_c(x).isNull().cast("int")).over(w)).cast("long")


def rank_min(x: Column | str, *by: str, descending: bool = False) -> Column:
    """Equal values share the smallest rank; nulls have none."""
    order = _c(x).desc_nulls_last() if descending else _c(x).asc_nulls_last()
    return F.when(_c(x).isNotNull(), F.rank().over(W.partitionBy(*by).orderBy(order)))


def min_max(x: Column | str, *by: str) -> Column:
    """W23."""
    w = W.partitionBy(*by)
    low, high = F.min(_c(x)).over(w), F.max(_c(x)).over(w)
    return F.try_divide(_c(x) - low, high - low)


def group_statistics(df: DataFrame, by: list[str], columns: Iterable[str]) -> DataFrame:
    """Median, mean, deviation, skewness and kurtosis of each column per group, in one aggregate."""
    made = []
    for c in columns:
        made += [F.median(c).alias(f"median_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"), F.skewness(c).alias(f"skew_{c}"), F.kurtosis(c).alias(f"kurtosis_{c}")]
    return df.groupBy(*by).agg(*made)


def normalise_all(df: DataFrame, plan: dict[tuple[str, ...], dict[str, Column]]) -> DataFrame:
    """Columns by partition key, one select per key, so that each key costs one exchange and one sort."""
    for columns in plan.values():
        df = df.select("*", *(c.alias(n) for n, c in columns.items()))
    return df


def rolling_time(x: Column, by: list[str], ts: str, length: str) -> Column:
    """The sum over (t - length, t] where times are whole seconds; `length` is an interval less the open end."""
    order = F.col(ts).cast("timestamp").cast("long")
    return F.sum(x).over(W.partitionBy(*by).orderBy(order).rangeBetween(-int(length) + 1, 0))


def rolling_rows(f, x: Column | str, by: list[str], order: list, n: int) -> Column:
    """An aggregate over the last n rows, fewer at the start."""
    return f(_c(x)).over(W.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0))


def macd(x: Column | str, by: list[str], order: list, fast: int = 5, slow: int = 10) -> Column:
    """W16."""
    return rolling_rows(F.avg, x, by, order, fast) - rolling_rows(F.avg, x, by, order, slow)


def previous_rows(x: Column | str, by: list[str], order: list, n: int) -> Column:
    """The n rows before this one, nulls left out."""
    return F.collect_list(_c(x)).over(W.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1))


def daily_spine(df: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """T5: a row for each day from a key's first to its last, 0 where there was none."""
    ends = df.groupBy(*by).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    spine = ends.select(*by, F.explode(F.sequence("a", "b")).alias(day))
    return spine.join(df, [*by, day], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def global_rolling_mean(df: DataFrame, ts: str, value: str, seconds: int, name: str) -> DataFrame:
    """W19 without a key: mean over [t - seconds, t] of all rows, without one task for all.

    Time is cut into buckets as wide as the window. A row needs its own bucket up to t and the tail of the one before, so each
    row is sent to two buckets and windows run per bucket.
    """
    t = F.col(ts).cast("timestamp").cast("double")
    bucket = F.floor(t / seconds)
    rows = df.withColumns({"__t": t, "__own": bucket}).withColumn("__b", F.explode(F.array("__own", F.col("__own") + 1)))
    # Microseconds as longs: a range over doubles could lose a tie.
    micros = F.round(F.col("__t") * 1e6).cast("long")
    w = W.partitionBy("__b").orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    out = rows.withColumn(name, F.avg(value).over(w)).where(F.col("__b") == F.col("__own"))
    return out.drop("__t", "__own", "__b")
