"""Windowed counts and sessions over streams, with watermarks for late rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.cuts import shared_dir


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """T4: counts per window; rows later than `late` behind the newest are dropped and their windows' state is freed."""
    return stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, length, slide or length).alias("w")).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Gap sessions per key."""
    return stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of the events table; NTZ times become instants, as watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(stream: DataFrame) -> DataFrame:
    """Counts per hour and type of event, of events that are at most an hour late."""
    return windowed_counts(stream, "ts", ["event_type"], "1 hour").select("event_type", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


def drained(counts: DataFrame, name: str) -> DataFrame:
    """What a stream of windowed counts has settled when its source is read to the end (availableNow), from Parquet under the shared folder: in append mode a window
    is written once, when the watermark has passed it, and its state is freed."""
    spark = counts.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    writer = counts.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/rows")


def hourly_counts_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14 over the events table: the hours that the newest event has closed, an hour of lateness allowed."""
    return drained(hourly_counts(read_events(spark, f"{sf_dir}/events.parquet")), "hourly")
