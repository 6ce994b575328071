"""Dense indices, global tiles, and sampling that depends on keys and a seed alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def dense_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0, 1, 2, ... in the given order, without bringing the rows to one task.

    Rows are dealt out by ranges of the order and numbered within their range; only one count a range is summed up over all.
    """
    key = "__range"
    ranged = df.repartitionByRange(*order).withColumn(key, F.spark_partition_id())
    ranged = ranged.withColumn("__place", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    counts = ranged.groupBy(key).agg(F.count("*").alias("__n"))
    # A row a partition, so this window is small however large the table is.
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    out = ranged.join(F.broadcast(starts), key)
    return out.select((F.col("__start") + F.col("__place") - 1).cast("long").alias(name), *df.columns)


def global_ntile(df: DataFrame, n: int, order: list[str], name: str) -> DataFrame:
    """Ntile over all rows: the first (count mod n) tiles hold one row more."""
    total = df.agg(F.count("*").alias("__total"))
    out = dense_index(df, order, "__i").crossJoin(F.broadcast(total))
    base, extra = F.expr(f"__total div {n}"), F.col("__total") % n
    edge = extra * (base + 1)
    tile = F.when(F.col("__i") < edge, F.expr("__i") / (base + 1)).otherwise(extra + (F.col("__i") - edge) / F.greatest(base, F.lit(1)))
    return out.select(*df.columns, (F.floor(tile) + 1).cast("int").alias(name))


def draw(*keys: str | Column, seed: int) -> Column:
    """A repeatable pseudo-random text of 32 digits for the keys: md5 of them and the seed, which any engine can compute."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", *(c.cast("string") for c in parts), F.lit(str(seed))).cast("binary"))


def draw_int(*keys: str | Column, seed: int) -> Column:
    """The first eight digits of a draw as a number below 2^32."""
    return F.conv(F.substring(draw(*keys, seed=seed), 1, 8), 16, 10).cast("long")


def shuffled(a: Column, key: Column, seed: int) -> Column:
    """A list in pseudo-random order."""
    tagged = F.transform(a, lambda x, i: F.struct(draw(key, i, x, seed=seed).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda s: s.x)


def sample_without(a: Column, n: int, key: Column, seed: int) -> Column:
    """N elements, without replacement; fewer if there are fewer."""
    return F.slice(shuffled(a, key, seed), 1, n)


def sample_with(a: Column, n: int, key: Column, seed: int) -> Column:
    """N elements with replacement; nulls where the list is empty."""
    pick = lambda i: F.get(a, F.pmod(draw_int(key, i, seed=seed), F.greatest(F.size(a), F.lit(1))).cast("int"))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), pick)


def negative_samples(impressions: DataFrame, ratio: int, seed: int, key: str = "impression_id") -> DataFrame:
    """A row per taken item: `ratio` items that were not taken (drawn with replacement, nulls if there are none), then the taken one."""
    rest = F.filter("inview", lambda x: ~F.array_contains("clicked", x))
    rows = impressions.select(key, rest.alias("rest"), F.posexplode("clicked").alias("at", "taken"))
    drawn = sample_with(F.col("rest"), ratio, F.concat_ws("/", F.col(key).cast("string"), F.col("at").cast("string")), seed)
    return rows.select(key, "at", "taken", F.concat(drawn, F.array("taken")).alias("items"))


def hash_split(df: DataFrame, key: str, share: float, seed: int, name: str = "train") -> DataFrame:
    """Rows of a key stay together; the share holds in expectation."""
    return df.withColumn(name, draw_int(key, seed=seed) < int(share * (1 << 32)))


def ranked_share(df: DataFrame, strata: list[str], keys: list[str], seed: int, name: str) -> DataFrame:
    """Each row's place in the random order of its stratum, 0 for the first, over the stratum's rows (share 0 to 1), as (…, place, rows).

    A stratum may hold most rows, so it is cut by the draw's first digits: places within a cut, plus the rows of the cuts before it.
    """
    cut = df.withColumn("__h", draw(*keys, seed=seed)).withColumn("__cut", F.substring("__h", 1, 3))
    counts = cut.groupBy(*strata, "__cut").agg(F.count("*").alias("__n"))
    # At most 4,096 rows a stratum.
    whole = W.partitionBy(*strata)
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__n").over(whole.orderBy("__cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), f"{name}_rows": F.sum("__n").over(whole)}).drop("__n")
    place = F.row_number().over(W.partitionBy(*strata, "__cut").orderBy("__h", *keys)) - 1
    return cut.withColumn("__place", place).join(counts, [*strata, "__cut"]).withColumn(f"{name}_place", F.col("__before") + F.col("__place")).drop("__h", "__cut", "__before", "__place")
