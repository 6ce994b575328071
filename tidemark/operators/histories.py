"""Histories: per key arrays of structs in time order, windows over them, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def history(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Key and `history`, an array of structs in order. Aligned by construction, unlike parallel lists."""
    s = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*(F.col(v).alias(v) for v in values)).alias("__v")))).alias("s"))
    return s.select(key, F.col("s.__v").alias("history"))


def fixed_history(df: DataFrame, key: str, order: list[str], values: list[str], n: int) -> DataFrame:
    """The last n only; older rows leave before the arrays are built, so an array never outgrows n."""
    last = F.row_number().over(W.partitionBy(key).orderBy(*(F.desc(o) for o in order)))
    return history(df.withColumn("__rn", last).where(F.col("__rn") <= n), key, order, values)


def merge_histories(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `old` whose keys `new` lacks, and all of `new`."""
    return old.join(new.select(*on).distinct(), on, "left_anti").select(*old.columns).unionByName(new)


def moving_folds(df: DataFrame, ts: str, start: str, train_days: int, val_days: int, stride: int, folds: int) -> DataFrame:
    """A row for each fold that a row belongs to, with `val`. Folds come from the time by arithmetic, so the data is read once."""
    day = 86_400
    at = F.timestamp_diff("MICROSECOND", F.lit(start).cast("timestamp_ntz"), F.col(ts)) / 1e6
    span = (train_days + val_days) * day
    last = F.least(F.floor(at / (stride * day)), F.lit(folds - 1))
    first = F.greatest(F.floor((at - span) / (stride * day)) + 1, F.lit(0))
    rows = df.withColumns({"__at": at, "__first": first, "__last": last}).where((F.col("__at") >= 0) & (F.col("__first") <= F.col("__last")))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.col("__first").cast("long"), F.col("__last").cast("long"))))
    inside = F.col("__at") - F.col("fold") * stride * day
    return rows.withColumn("val", inside >= train_days * day).drop("__at", "__first", "__last")


def sequence_windows(df: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """The last n values up to each row, filled with 0 on the left, and the value that follows as target; rows without one go."""
    w = W.partitionBy(key).orderBy(order)
    got = F.collect_list(value).over(w.rowsBetween(-(n - 1), 0))
    out = df.select(key, order, got.alias("g"), F.lead(value).over(w).alias("target")).where("target is not null")
    return out.select(key, order, F.concat(F.array_repeat(F.lit(0).cast("long"), n - F.size("g")), "g").alias("inputs"), "target")
