"""Sparse matrices as frames of (row, col, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """A join on the inner index and a map-side combined sum; AQE splits skewed inner indices."""
    right = b.select(F.col("row").alias("__k"), F.col("col").alias("__c"), F.col("value").alias("__v"))
    both = a.join(right, a["col"] == F.col("__k"))
    return both.groupBy("row", F.col("__c").alias("col")).agg(F.sum(F.col("value") * F.col("__v")).alias("value"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def top_per(df: DataFrame, key: str, value: str, ties: list[str], k: int, by_size: bool = False) -> DataFrame:
    """The k largest per key; Spark cuts each task's rows to k before the shuffle."""
    order = F.desc(F.abs(F.col(value))) if by_size else F.desc(value)
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(order, *ties))).where(F.col("__r") <= k).drop("__r")


def normalise(df: DataFrame, key: str, value: str = "value") -> DataFrame:
    """L1 per key; rows of a key that sums to 0 become 0."""
    total = F.sum(F.abs(F.col(value))).over(W.partitionBy(key))
    return df.withColumn(value, F.coalesce(F.try_divide(F.col(value), total), F.lit(0.0)))


def random_zeros(m: DataFrame, per_row: int, seed: int) -> DataFrame:
    """`per_row` columns a row, of those that some other row holds and it does not; all of them where there are fewer.

    Drawn from the items themselves, by a hash of row and column: the row takes the first of them from a place on the circle of all columns that its own hash
    gives, as many as it has entries and `per_row` more, so enough are left when its own are taken out.
    """
    from .sampling import dense_index

    columns = dense_index(m.select("col").distinct().withColumn("__h", F.xxhash64("col", F.lit(seed))), ["__h", "col"], "__at").select("col", "__at")
    rows = m.groupBy("row").agg(F.count_distinct("col").alias("__n")).crossJoin(F.broadcast(columns.agg(F.count("*").alias("__all"))))
    many = F.least(F.col("__n") + per_row, F.col("__all"))
    start = F.pmod(F.xxhash64("row", F.lit(seed)), F.col("__all"))
    drawn = rows.select("row", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), many - 1), lambda i: F.pmod(start + i, F.col("__all")))).alias("__at"))
    absent = drawn.join(columns, "__at").select("row", "col").join(m.select("row", "col"), ["row", "col"], "left_anti")
    return absent.withColumn("__r", F.row_number().over(W.partitionBy("row").orderBy(F.xxhash64("row", "col", F.lit(seed)), "col"))).where(F.col("__r") <= per_row).drop("__r")
