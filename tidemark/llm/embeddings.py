"""Embedding near-dedup: cross-polytope hashes after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize
from .graph import components

#: Tables, hashes joined in a table's key, and vectors that one task multiplies with one another.
TABLES, HASHES, BLOCK = 8, 2, 1000
SEED = 20240229


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, in log2(width) steps."""
    n, width, step = len(x), x.shape[1], 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(n, width)
        step *= 2
    return x


def polytope_codes(vectors: np.ndarray, tables: int = TABLES, hashes: int = HASHES) -> np.ndarray:
    """(vectors, tables, 1 + hashes): each table's own bucket, then a probe for each hash with its second nearest vertex."""
    width = 1 << max(0, vectors.shape[1] - 1).bit_length()
    base = np.zeros((len(vectors), width))
    base[:, : vectors.shape[1]] = vectors
    out = np.zeros((len(vectors), tables, 1 + hashes), np.int64)
    rows = np.arange(len(vectors))
    for t in range(tables):
        best, next_ = [], []
        for h in range(hashes):
            signs = np.random.default_rng((SEED, t, h)).choice((-1.0, 1.0), (3, width))
            turned = base
            for s in signs:
                turned = hadamard(turned * s)
            size = np.abs(turned)
            for found in (best, next_):
                top = size.argmax(1)
                found.append(2 * top + (turned[rows, top] < 0))
                size[rows, top] = -1
        key = lambda parts: np.stack(parts, 1) @ ((2 * width) ** np.arange(len(parts), dtype=np.int64)[::-1])
        out[:, t, 0] = key(best)
        for h in range(hashes):
            out[:, t, 1 + h] = key([next_[i] if i == h else best[i] for i in range(hashes)])
    return out


def _mark(v) -> tuple[int, int] | None:
    """The fingerprint of a vector that is fit to link."""
    if not v or any(x is None for x in v):
        return None
    x = np.array(v, np.float64) + 0.0
    if not (np.isfinite(x).all() and x.any()):
        return None
    mark = xxhash.xxh3_128_intdigest(x.tobytes())
    return (mark >> 64) - (1 << 63), (mark & (1 << 64) - 1) - (1 << 63)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors fit to link, with their fingerprints."""
    for batch in batches:
        marks = [_mark(v) for v in batch.column("vector").to_pylist()]
        keep = [i for i, m in enumerate(marks) if m]
        kept = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([marks[i][k] for i in keep], pa.int64()) for k in (0, 1))], names=[*batch.schema.names, "fp1", "fp2"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row, with the fingerprint in place of the vector; null where it is not fit to link."""
    for batch in batches:
        marks = [_mark(v) or (None, None) for v in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec"), batch.column("label"), *(pa.array([m[k] for m in marks], pa.int64()) for k in (0, 1))], names=["vec", "label", "fp1", "fp2"])


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    values = batch.column("vector").to_pylist()
    widths = np.array([len(v) for v in values])
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        yield rows, np.array([values[i] for i in rows], np.float64)


def _buckets(batches: Iterator[pa.RecordBatch], tables: int, hashes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, label = batch.column("head").to_numpy(), batch.column("label").to_numpy()
        for rows, x in _by_width(batch):
            codes = polytope_codes(x / np.abs(x).max(1, keepdims=True), tables, hashes)
            n, _, probes = codes.shape
            column = lambda v: pa.array(np.broadcast_to(v, codes.shape).reshape(-1))
            yield pa.RecordBatch.from_arrays([column(ids[rows][:, None, None]), column(label[rows][:, None, None]), column(np.int64(x.shape[1])), column(np.arange(tables)[None, :, None]), pa.array(codes.reshape(-1)), column(np.arange(probes) == 0)], names=["head", "label", "width", "t", "code", "home"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, from sorted batches."""
    spare: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if spare and any(spare[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(spare)
            spare = []
        cuts = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            spare.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(spare)
                spare = []
    if spare:
        yield pa.Table.from_batches(spare)


def _products(batches: Iterator[pa.RecordBatch], least: float, tables: int, hashes: int) -> Iterator[pa.RecordBatch]:
    """Per pair of blocks: for each vector the copies it links with, counted at the first bucket where the two meet, and a star for
    each connected set of them. No pair leaves the task."""
    for group in _groups(batches, ["label", "width", "t", "code", "low", "high"]):
        if group.num_rows < 2:
            continue
        ids, vec, own, block, home = (group.column(c).to_numpy() for c in ("head", "vec", "copies", "block", "home"))
        t, code, low, high = (group.column(c)[0].as_py() for c in ("t", "code", "low", "high"))
        x = np.array(group.column("vector").to_pylist(), np.float64)
        # The longest entry is scaled to 1 first, so no square overflows; cosines do not change.
        x /= np.abs(x).max(1, keepdims=True)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        close = x @ x.T / np.outer(norm, norm)
        near = close >= least
        for i, j in np.argwhere(np.abs(close - least) < 1e-12):
            near[i, j] = float(np.sum(x[i] * x[j])) / float(norm[i] * norm[j]) >= least
        near &= ids[:, None] != ids
        near &= home[:, None] | home
        if low != high:
            near &= block[:, None] != block
        if not near.any():
            continue
        rows = np.flatnonzero(near.any(1))
        near, ids, vec, own, x = near[np.ix_(rows, rows)], ids[rows], vec[rows], own[rows], x[rows]
        codes = polytope_codes(x, tables, hashes)
        seen = np.zeros_like(near)
        for s in range(t + 1):
            mine, probes = codes[:, s, 0], codes[:, s, 1:]
            for met in [np.equal.outer(mine, mine), *(np.equal.outer(mine, p) for p in probes.T), *(np.equal.outer(p, mine) for p in probes.T)]:
                if s < t:
                    seen |= met
        # Within this table a pair can meet in more than one bucket: it counts in that of the smallest code.
        def holds(c):
            h, p = codes[:, t, 0] == c, (codes[:, t] == c).any(1)
            return np.logical_or(np.logical_and.outer(h, p), np.logical_and.outer(p, h))

        for c in np.unique(codes[:, t]):
            if c < code:
                seen |= holds(c)
        near &= ~seen
        if not near.any():
            continue
        top = vec.copy()
        while True:
            new = np.minimum(top, np.where(near, top[None, :], np.iinfo(np.int64).max).min(1))
            if (new == top).all():
                break
            top = new
        links = near @ own
        keep = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(vec[keep]), pa.array(top[keep]), pa.array(links[keep])], names=["head", "vec", "top", "links"])


def near_duplicates(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, hashes: int = HASHES, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) a row: links join vectors of one label whose cosine, in double precision, is `least` or more.

    Null, zero or empty vectors, those with null or non-finite entries, and null labels link with nothing. Vectors of different
    lengths do not link. Rows that repeat id, label and vector are one vector and get equal results. Vectors or labels that clash under one id are
    vectors of their own, each with its own n_links, and share the id's component; rows of a null id have null component and kept.

    Equal vectors meet by fingerprint and count as copies of one head. Each head goes to its bucket in every
    table and probes one more a hash; buckets with one vector end there; the rest are multiplied in pairs of blocks, so a bucket with
    a third of all vectors is many tasks. A pair counts where it first meets, so links need no pair list. Every pair of a bucket is
    multiplied: n_links counts all of them, so one chosen vector of the bucket cannot stand for the others.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = base.where("vec is not null and label is not null and vector is not null").mapInArrow(_clean, "vec long, label long, vector array<double>, fp1 long, fp2 long")
    good = materialize(good, "vectors")
    key = ["label", "fp1", "fp2"]
    ids = good.select("vec", *key).distinct()
    reps = ids.groupBy(*key).agg(F.min("vec").alias("vec"), F.count("*").alias("copies"))
    one = good.groupBy("vec", *key).agg(F.first("vector").alias("vector"))
    # Numbered once, as they are written.
    heads = materialize(one.join(reps, [*key, "vec"]).select(F.monotonically_increasing_id().alias("head"), "vec", *key, "vector", "copies"), "heads")
    place = ["label", "width", "t", "code"]
    rows = heads.select("head", "label", "vector").mapInArrow(partial(_buckets, tables=tables, hashes=hashes), "head long, label long, width long, t long, code long, home boolean")
    rows = materialize(rows, "buckets")
    full = rows.groupBy(*place).agg(F.count("*").alias("n"), F.max("home").alias("any")).where("n > 1 and any")
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = rows.join(full.select(*place, blocks.alias("blocks")), place).withColumn("block", F.pmod(F.xxhash64("head"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(*place, "head", "home", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    dealt = dealt.join(heads.select("head", "vec", "vector", "copies"), "head").repartition(*place, "low", "high").sortWithinPartitions(*place, "low", "high")
    found = materialize(dealt.mapInArrow(partial(_products, least=least, tables=tables, hashes=hashes), "head long, vec long, top long, links long"), "links")
    discard(rows)
    part = components(ids.join(reps.select(*key, F.col("vec").alias("top")), key).select(F.col("vec").alias("u"), F.col("top").alias("v")).unionByName(found.select(F.col("vec").alias("u"), F.col("top").alias("v"))))
    links = found.groupBy("head").agg(F.sum("links").alias("links"))
    counts = heads.select("head", *key, "copies").join(links, "head", "left").select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    each = ids.join(counts, key)
    out = base.mapInArrow(_marked, "vec long, label long, fp1 long, fp2 long").join(each, ["vec", *key], "left").join(part.withColumnRenamed("node", "vec"), "vec", "left")
    component = F.when(F.col("vec").isNotNull(), F.coalesce("component", "vec"))
    return out.select(F.col("vec").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec") == component).alias("kept"))
