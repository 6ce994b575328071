"""Cut points of iterative plans: a table in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _own(application: str) -> str:
    folder = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, one of our own if driver and executors are one process (tests); on a cluster, whose
    machines share no local folder, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own(spark.sparkContext.applicationId)
    return found.rstrip("/")


@contextmanager
def _given_back(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of the jobs within are given back at the end of each."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in that folder, read back. The shuffle files of that job are given back at its end."""
    return gathered([df])


def gathered(parts: Iterable[DataFrame]) -> DataFrame:
    """The parts, one at least, as one table in that folder. They are written one after the other, so the shuffles of one alone are on disk at a time."""
    path = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{shared_dir(spark)}/tidemark/cut-{uuid.uuid4().hex}"
        with _given_back(spark):
            df.write.mode("append").option("compression", "zstd").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    found._tidemark_path = path
    return found


def share(key, k: int, rounds: int):
    """Whether a key is in share k of `rounds`; a null is in one of them, too."""
    return F.pmod(F.xxhash64(key), F.lit(rounds)) == k


def clustered(df: DataFrame, key: str, rounds: int = 1) -> DataFrame:
    """df as a table in that folder in as many buckets by `key` as the session has shuffle partitions: joins and windows by it read them without a shuffle.
    The rows come there in rounds, a share of the buckets each."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"tidemark_{uuid.uuid4().hex}"
    for k in range(rounds):
        part = df.where(F.pmod(F.hash(key), F.lit(n)) % rounds == k).repartition(n, key)
        with _given_back(spark):
            part.write.mode("append").option("compression", "zstd").option("path", f"{shared_dir(spark)}/tidemark/{name}").bucketBy(n, key).saveAsTable(name, format="parquet")
    return spark.table(name)


def discard(cut: DataFrame) -> None:
    """Deletes a cut that nothing reads any more: what came from it has itself been written."""
    context = cut.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(cut._tidemark_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df marked for a broadcast if it has so many rows at most; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
