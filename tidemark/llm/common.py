"""Shared plumbing: written cut points, Arrow batches, spans over byte buffers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

CHECKPOINT = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@cache
def _own_dir(application: str) -> str:
    folder = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session. Where it is unset, one of our own if driver and executors are one process (tests); on a
    cluster, whose machines share no local folder, an error."""
    found = spark.conf.get(CHECKPOINT, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT} must name a folder that all executors share")
        found = _own_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, for clusters where it is not installed."""
    context = spark.sparkContext
    if not getattr(context, "_tidemark_sent", False):
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = Path(__file__).resolve().parents[2]
        with zipfile.ZipFile(f"{folder}/tidemark_llm.zip", "w") as out:
            for path in (root / "tidemark/__init__.py", *sorted((root / "tidemark/llm").glob("*.py"))):
                out.write(path, path.relative_to(root))
        context.addPyFile(f"{folder}/tidemark_llm.zip")
        context._tidemark_sent = True


def materialize(df: DataFrame, name: str = "cut", compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage ends there and survives lost executors.

    The shuffle files of that one job are given back as soon as it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._tidemark_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes cuts that nothing reads any more: what came from them has itself been written."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, mb: int = 4) -> None:
    """Limits an Arrow batch by bytes, so long texts do not add up to one huge batch; and sends the package along."""
    ship(spark)
    spark.conf.set(_BATCH, str(mb << 20))


_slot: list = [None, None]


def worker_cache(key, build):
    """What a worker keeps between tasks: one object, so that operators that follow each other in it do not add up."""
    if _slot[0] != key:
        _slot[:] = None, None
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        _slot[:] = key, build()
    return _slot[1]


def reuse_memory(mb: int = 32) -> None:
    """For workers that ask for and give back buffers of some MB all the time: up to so much freed memory stays in the process, so that the
    system does not have to clear it anew for each buffer. The options are glibc's thresholds for trimming and for mapping."""
    with contextlib.suppress(OSError, AttributeError):
        for option in (-1, -3):
            ctypes.CDLL(None).mallopt(option, mb << 20)


def no_cache() -> None:
    """For operators that keep nothing: what another one left in this worker goes."""
    worker_cache("none", lambda: None)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cuts batches where the given string or binary column passes `limit` bytes; a row is never split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def map_rows(docs: DataFrame, run, more: tuple[StructField, ...] = ()) -> DataFrame:
    """docs through `run` (batches to batches), with all its columns and those in `more`; names may hold dots or repeat what `run` uses."""
    bounded_batches(docs.sparkSession)
    fields = [StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    out = docs.toDF(*(f.name for f in fields)).mapInArrow(run, StructType([*fields, *more]))
    return out.toDF(*docs.columns, *(f.name for f in more))


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
