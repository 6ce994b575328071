"""As-of joins by one union and one window per direction: no pairs of a key are formed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], direction: str = "backward") -> DataFrame:
    """Left with `values` of the right row that is last at or before (backward), first at or after (forward) or nearest.

    Nearest prefers the earlier row at equal distance. Right rows of one key and time must not differ in `values`. With no keys, rows are ordered as
    one sequence; give a key (a day, say) where that is too long for one task. Left rows without a partner get nulls.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(direction)
    found = F.struct(F.col(on).alias("t"), *values)
    tag = left.select(*by, on, F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(found.alias("s")).schema["s"].dataType).alias("__found"))
    rows = tag.unionByName(right.select(*by, on, found.alias("__found")), allowMissingColumns=True)
    order = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    is_left = F.col("__row").isNotNull()
    # At equal times the right row comes first, in either direction.
    before = F.last("__found", ignorenulls=True).over(order.orderBy(on, is_left).rowsBetween(W.unboundedPreceding, 0))
    # Looking ahead is a running value too, over the falling order.
    after = F.last("__found", ignorenulls=True).over(order.orderBy(F.desc(on), is_left).rowsBetween(W.unboundedPreceding, 0))
    if direction == "backward":
        rows = rows.withColumn("__hit", before)
    elif direction == "forward":
        rows = rows.withColumn("__hit", after)
    else:
        rows = rows.withColumns({"__b": before, "__a": after})
        gap = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
        nearer = gap(F.col("__b.t"), F.col(on)) <= gap(F.col(on), F.col("__a.t"))
        rows = rows.withColumn("__hit", F.when(F.col("__a").isNull() | nearer, F.col("__b")).otherwise(F.col("__a")))
    rows = rows.where("__row is not null")
    return rows.select("__row.*", *(F.col(f"__hit.{v}").alias(v) for v in values))
