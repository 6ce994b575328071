"""Session settings the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "tidemark", **conf: str) -> SparkSession:
    """UTC, ANSI errors on, adaptive execution on with skew joins; partition counts are left to adaptive coalescing."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
