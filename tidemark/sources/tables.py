"""Base tables and the roles they play: impressions, candidates, history, items, vectors.

Every view is lazy and reads only the columns it returns. Arrays are built once per key with an explicit order, so equal
input gives equal arrays whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table, pruned to the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def dataset(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """S3: several tables of one folder by name."""
    return {n: table(spark, sf_dir, n) for n in names}


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per shown item: impression_id, article, seller, position, target (1 if it was taken), price, quantity, shown."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("impression_id"), F.col("l_partkey").alias("article"), F.col("l_suppkey").alias("seller"), F.col("l_linenumber").alias("position"),
        (F.col("l_returnflag") == "R").cast("int").alias("target"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("shown"),
    )


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per impression with its items in order: impression_id, user_id, ts, inview, clicked (both arrays of longs)."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", *LINE_ORDER, "l_returnflag")
    shown = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "l_returnflag"))).alias("s"))
    shown = shown.select(F.col("l_orderkey").alias("impression_id"), F.col("s.l_partkey").alias("inview"), F.filter("s", lambda x: x.l_returnflag == "R").getField("l_partkey").alias("clicked"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    orders = orders.select(F.col("o_orderkey").alias("impression_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    return orders.join(shown, "impression_id")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per taken item: user_id, impression_id, ts, article, seller, quantity, price."""
    taken = candidates(spark, sf_dir).where("target = 1").select("impression_id", "article", "seller", "quantity", "price")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    orders = orders.select(F.col("o_orderkey").alias("impression_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    return taken.join(orders, "impression_id")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: article, category, kind, size, price, topics (the words of its name), published (first day it was shown)."""
    part = table(spark, sf_dir, "part")
    first = table(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate").groupBy("l_partkey").agg(F.min("l_shipdate").alias("published"))
    part = part.select(F.col("p_partkey").alias("article"), F.col("p_brand").alias("category"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.split("p_name", " ").alias("topics"))
    return part.join(first.withColumnRenamed("l_partkey", "article"), "article", "left")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article, vector): embeddings by item."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article"), F.col("embedding").cast("array<double>").alias("vector"), "label")


#: The same views for DuckDB, as common table expressions.
SQL = {
    "cand": "cand AS (SELECT l_orderkey AS impression_id, l_partkey AS article, l_suppkey AS seller, l_linenumber AS position, (l_returnflag = 'R')::INTEGER AS target, l_extendedprice AS price, l_quantity AS quantity, l_shipdate AS shown FROM lineitem)",
    "imp": "imp AS (SELECT o_orderkey AS impression_id, o_custkey AS user_id, o_orderdate AS ts, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS inview, coalesce(list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE l_returnflag = 'R'), []) AS clicked FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate)",
    "clicks": "clicks AS (SELECT o_custkey AS user_id, o_orderkey AS impression_id, o_orderdate AS ts, l_partkey AS article, l_suppkey AS seller, l_quantity AS quantity, l_extendedprice AS price FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')",
    "items": "items AS (SELECT p_partkey AS article, p_brand AS category, p_type AS kind, p_size AS size, p_retailprice AS price, string_split(p_name, ' ') AS topics, f.published FROM part LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS published FROM lineitem GROUP BY 1) f ON p_partkey = f.l_partkey)",
    "vec": "vec AS (SELECT vec_id AS article, embedding::DOUBLE[] AS vector, label FROM embeddings)",
}


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
