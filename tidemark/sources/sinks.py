"""Sinks: submission text, graph files, sparse matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def submission_lines(scores: DataFrame, key: str, score: str, order: list[str], ties: list[str]) -> DataFrame:
    """A line 'key [r1,...,rn]' per key: the rank of each item by falling score, items in the given order."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), *ties))
    ranked = scores.select(key, *order, rank.alias("rank"))
    rows = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "rank"))).alias("s"))
    return rows.select(F.concat(F.col(key).cast("string"), F.lit(" ["), F.array_join(F.transform("s", lambda x: x.rank.cast("string")), ","), F.lit("]")).alias("line"))


def parse_submission(lines: DataFrame) -> DataFrame:
    """(impression_id, place, rank) of submission lines."""
    parts = lines.select(F.split("line", " ", 2).alias("p"))
    ranks = F.from_json(F.element_at("p", 2), "array<int>")
    return parts.select(F.element_at("p", 1).cast("long").alias("impression_id"), F.posexplode(ranks).alias("place", "rank")).withColumn("place", F.col("place") + 1)


def write_submission(lines: DataFrame, path: str) -> None:
    """Text files, gzip-compressed."""
    lines.write.option("compression", "gzip").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, kind: str) -> None:
    """CSV with the typed headers that bulk loaders of property graphs read."""
    nodes.select(F.col("id").alias("id:ID"), F.lit(kind).alias(":LABEL")).write.option("header", True).csv(f"{path}/nodes")
    edges.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), F.col("type").alias(":TYPE")).write.option("header", True).csv(f"{path}/edges")


def stack_slices(spark, paths: list[str], out: str, files: int) -> None:
    """Many slices written as a few files."""
    spark.read.parquet(*paths).repartition(files).write.parquet(out)


def read_csv(spark, path: str, schema: str, separator: str = ",", header: bool = True) -> DataFrame:
    """Typed CSV; bad rows fail rather than become nulls."""
    return spark.read.schema(schema).option("sep", separator).option("header", header).option("mode", "FAILFAST").csv(path)


def write_coo(matrix: DataFrame, path: str) -> None:
    """A sparse matrix as (row, col, value) Parquet, clustered by row."""
    matrix.select("row", "col", "value").repartitionByRange("row", "col").sortWithinPartitions("row", "col").write.parquet(path)
