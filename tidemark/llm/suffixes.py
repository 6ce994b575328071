"""Suffix-array dedup: exact repeats of a fixed length over all documents.

A difference-cover sort of every suffix of the corpus would move several bytes for each byte of text. So suffixes are dealt
into buckets first, by an anchor that any two equal strings share, and the difference-cover algorithm sorts within the
buckets that hold more than one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, slices, texts
from .shingles import _BASE, _BYTE, mix

#: Bytes of a repeated string, and of the anchor within it.
LENGTH, ANCHOR = 100, 32
#: Bytes of contexts in one suffix array, and contexts of one anchor in one block; an anchor with more has several, which are merged after.
BLOCK, PER_BLOCK = 1 << 18, 2000
_LOW = (1 << 24) - 1
_PIECE = 1 << 17


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `length` bytes: where its anchor is (the leftmost of the smallest hash), and that hash.

    The anchor depends on the window's bytes alone, so equal windows have equal anchors at equal places.
    """
    x, step = _BYTE[data], 1
    while step < ANCHOR:
        x = x[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + x[step:]
        step *= 2
    x = mix(x)
    key = (x & ~np.uint64(_LOW)) | np.arange(len(x), dtype=np.uint64)
    width, step = length - ANCHOR + 1, 1
    while 2 * step <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if width > step:
        key = np.minimum(key[: step - width], key[width - step :])
    place = (key & np.uint64(_LOW)).astype(np.int64)
    return place, x[place]


def _pieces(parts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of some MB: their bytes, and for each document in them its number, offset there and offset in its own text."""
    held, size = [], 0
    for i, text in enumerate(parts):
        at = 0
        while len(text) - at >= length:
            part = text[at : at + _PIECE]
            held.append((i, at, part))
            size += len(part)
            if size >= _PIECE:
                yield _joined(held)
                held, size = [], 0
            if at + len(part) == len(text):
                break
            at += len(part) - length + 1
    if held:
        yield _joined(held)


def _joined(held):
    data = np.frombuffer(b"".join(p for *_, p in held), np.uint8)
    ends = np.cumsum([len(p) for *_, p in held])
    return data, np.array([(i, at) for i, at, _ in held], np.int64).T, ends


def _runs(batches: Iterator[pa.RecordBatch], length: int, whole: bool = True) -> Iterator[pa.RecordBatch]:
    """A row for each run of windows with one anchor: the anchor's hash, and as a whole that of the run's bytes, document, first window, windows."""
    for batch in slices(batches, "text", _PIECE):
        ids = batch.column("doc").to_numpy()
        for data, (number, origin), ends in _pieces(texts(batch, "text"), length):
            place, found = anchors(data, length)
            starts = np.concatenate(([0], ends[:-1]))
            valid = np.ones(len(place) + 1, bool)
            for e in ends:
                valid[max(0, e - length + 1) : e] = False
            valid[-1] = False
            new = valid[:-1].copy()
            new[1:] &= (place[1:] != place[:-1]) | ~valid[:-2]
            low = np.flatnonzero(new)
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array(found[low].view(np.int64))], names=["anchor"])
                continue
            stops = np.flatnonzero(valid[:-1] & (~valid[1:] | np.concatenate((new[1:], [True]))))
            n = stops - low + 1
            raw = data.tobytes()
            digest = xxhash.xxh3_64_intdigest
            bytes_of = [digest(raw[a:b]) for a, b in zip(low.tolist(), (stops + length).tolist(), strict=True)]
            doc = np.searchsorted(starts, low, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(found[low].view(np.int64)), pa.array(np.array(bytes_of, np.uint64).view(np.int64)), pa.array(ids[number[doc]]), pa.array((low - starts[doc] + origin[doc]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["anchor", "content", "doc", "start", "n"])


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, name of each, number of names): equal keys get equal names, in order."""
    order = np.argsort(keys)
    ranked = keys[order]
    name = np.concatenate(([1], 1 + np.cumsum(ranked[1:] != ranked[:-1]))).astype(np.int64)
    out = np.empty(len(keys), np.int64)
    out[order] = name
    return order, out, int(name[-1])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Difference cover modulo 3, on positive integers: the suffixes at places 1 and 2 modulo 3 are sorted by naming their
    triples and recursing on the names; those at 0 follow from their first symbol and the next rank; then both are merged."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    top = int(s.max()) + 1
    padded = np.concatenate((s, np.zeros(3, np.int64)))
    one = np.arange(1, n + (n % 3 == 1), 3)
    sample = np.concatenate((one, np.arange(2, n, 3)))
    pair = padded[sample] * top + padded[sample + 1]
    if top**3 >= 1 << 62:
        pair = _names(pair)[1]
    triple = pair * top + padded[sample + 2]
    order, name, count = _names(triple)
    sorted_sample = sample[order] if count == len(sample) else sample[suffix_array(name)]
    rank = np.zeros(n + 3, np.int64)
    rank[sorted_sample] = np.arange(1, len(sorted_sample) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    zero = np.arange(0, n, 3)
    big = len(rank)
    zero = zero[np.argsort(padded[zero] * big + rank[zero + 1])]
    # Merge: how many sampled suffixes of either kind come before each other suffix.
    ones, twos = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(padded[ones] * big + rank[ones + 1], padded[zero] * big + rank[zero + 1])
    second = _pair_names(padded, twos, zero, top)
    before += np.searchsorted(second[0] * big + rank[twos + 2], second[1] * big + rank[zero + 2])
    at = before + np.arange(len(zero))
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[at] = False
    out[at] = zero
    out[free] = sorted_sample
    return out


def _pair_names(padded: np.ndarray, a: np.ndarray, b: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the first two symbols at places a and b, small enough to stand before a rank."""
    both = np.concatenate((a, b))
    _, name, _ = _names(padded[both] * top + padded[both + 1])
    return name[: len(a)], name[len(a) :]


def repeats(contexts: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[list[tuple[int, int, int]], Iterator[tuple[int, int]]]:
    """(context, first window, windows) of each run of windows whose bytes also begin earlier, by (document, place); and (context, window) of
    the first of each set of equal windows.

    Contexts are joined with a separator between, their suffixes sorted, and neighbours compared over `length` bytes.
    """
    data = np.frombuffer(b"\0".join(contexts) + b"\0" * 8, np.uint8)
    size = np.array([len(c) for c in contexts])
    base = np.concatenate(([0], np.cumsum(size[:-1] + 1)))
    n = int(base[-1] + size[-1])
    symbols = data[:n].astype(np.int64) + 2
    symbols[base[1:] - 1] = 1
    owner = np.repeat(np.arange(len(contexts)), size + 1)[:n]
    offset = np.arange(n) - base[owner]
    valid = offset + length <= size[owner]
    order = suffix_array(symbols)
    order = order[valid[order]]
    word = data[:n].astype(np.uint64)
    for k in range(1, 8):
        word |= data[k : n + k].astype(np.uint64) << np.uint64(8 * k)
    same = np.ones(len(order) - 1, bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        column = word[order + k]
        same &= column[1:] == column[:-1]
    group = np.concatenate(([0], np.cumsum(~same)))
    where = np.lexsort((starts[owner[order]] + offset[order], docs[owner[order]]))
    rank = np.empty(len(order), np.int64)
    rank[where] = np.arange(len(order))
    first = np.minimum.reduceat(rank, np.flatnonzero(np.concatenate(([True], ~same))))
    marked = np.zeros(n + 1, bool)
    marked[order[rank != first[group]]] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([False], marked)).view(np.int8)))
    runs = [(int(owner[a]), int(offset[a]), b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    heads = order[rank == first[group]]
    return runs, zip(owner[heads].tolist(), offset[heads].tolist(), strict=True)


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that were asked for, cut from their documents."""
    for batch in slices(batches, "text", _PIECE):
        out = [], [], [], [], [], []
        for doc, text, asked in zip(batch.column("doc").to_pylist(), texts(batch, "text"), batch.column("asked").to_pylist(), strict=True):
            for a in asked:
                for column, value in zip(out, (a["anchor"], a["block"], a["blocks"] > 1, doc, a["start"], text[a["start"] : a["start"] + a["n"] - 1 + length]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "block", "several", "doc", "start", "context"])


def _sorted_blocks(batches: Iterator[pa.RecordBatch], length: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and block: suffix arrays over whole blocks, several in one. A row for each run of repeated windows, without `window`; and of anchors with several
    blocks one for the first of each set of equal windows, with a hash of its bytes."""
    rows: list[tuple] = []
    size = 0

    def flush():
        docs, starts = [r[3] for r in rows], [r[4] for r in rows]
        found, heads = repeats([r[5] for r in rows], np.array(docs, np.int64), np.array(starts, np.int64), length)
        out = [(docs[c], starts[c] + at, n, None) for c, at, n in found]
        out += [(docs[c], starts[c] + at, 1, xxhash.xxh3_128_digest(rows[c][5][at : at + length])) for c, at in heads if rows[c][2]]
        kinds = {"doc": pa.int64(), "start": pa.int32(), "n": pa.int32(), "window": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds.values(), strict=True)], names=list(kinds))

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "block", "several", "doc", "start", "context")), strict=True):
            if size >= block and row[:2] != rows[-1][:2]:
                yield flush()
                rows, size = [], 0
            rows.append(row)
            size += len(row[5])
    if rows:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    for batch in slices(batches, "text", _PIECE):
        out = [[] for _ in names]
        marks = batch.column("marks").to_pylist()
        for doc, text, found in zip(batch.column("doc").to_pylist(), texts(batch, "text"), marks, strict=True):
            spans: list[list[int]] = []
            for a, b in sorted((m["start"], m["start"] + m["n"] - 1 + length) for m in found or ()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            kept, past = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(text[past:a])
                past = b
            kept.update(text[past:])
            row = (doc, len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans])
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) a row: bytes covered by a string of `length` bytes that also starts
    earlier, in a smaller id or before in the same document; spans are byte offsets, end exclusive.

    Null text is empty. Texts below `length` bytes keep all. Rows that repeat an id and a text get equal results; ids are
    taken to name one text. Rows of a null id are kept whole and count for nothing.

    1. Windows get an anchor, the smallest hash in them; runs of windows with one anchor are the rows from here on, about one
       to 35 bytes. Anchors that occur once leave.
    2. Runs with equal bytes: all windows of all but the first are repeats.
    3. Where an anchor has runs of different bytes, the first of each goes to a suffix array with the others, made by the
       difference-cover algorithm, and neighbours in it that share `length` bytes are repeats, but for the first by place.
       PER_BLOCK such runs of one anchor are a block; where an anchor has several, the first windows of each block are merged by their bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    known = base.where("doc is not null")
    runs = known.mapInArrow(partial(_runs, length=length), "anchor long, content long, doc long, start int, n int")
    often = known.mapInArrow(partial(_runs, length=length, whole=False), "anchor long").groupBy("anchor").count().where("count > 1").select("anchor")
    # Written first: a join of two plain exchanges is one that Spark can split where an anchor is frequent.
    often = materialize(often, "anchors")
    runs = materialize(runs.join(often, "anchor", "left_semi"), "runs")
    discard(often)
    key = ["anchor", "content"]
    first = runs.groupBy(*key).agg(F.min(F.struct("doc", "start", "n")).alias("first"))
    variants = first.groupBy("anchor").agg(F.count("*").alias("variants"))
    first = materialize(first.join(variants, "anchor").select(*key, "first", "variants"), "first")
    later = runs.join(first.select(*key, "first"), key).where("doc <> first.doc or start <> first.start").select("doc", "start", "n")
    blocks = F.ceil(F.col("variants") / PER_BLOCK)
    one = F.struct("anchor", F.pmod(F.xxhash64("first.doc", "first.start"), blocks).alias("block"), blocks.alias("blocks"), F.col("first.start").alias("start"), F.col("first.n").alias("n"))
    asked = first.where("variants > 1").groupBy(F.col("first.doc").alias("doc")).agg(F.collect_list(one).alias("asked"))
    contexts = known.join(asked, "doc")
    contexts = materialize(contexts.mapInArrow(partial(_contexts, length=length), "anchor long, block long, several boolean, doc long, start int, context binary"), "contexts")
    dealt = contexts.repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    found = materialize(dealt.mapInArrow(partial(_sorted_blocks, length=length, block=BLOCK), "doc long, start int, n int, window binary"), "repeats")
    windows = found.where("window is not null").drop("n")
    heads = windows.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("first"))
    merged = windows.join(heads, "window").where("doc <> first.doc or start <> first.start").select("doc", "start", F.lit(1).alias("n"))
    marks = later.unionByName(found.where("window is null").drop("window")).unionByName(merged)
    marks = materialize(marks.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("marks")), "marks")
    discard(runs, first, contexts, found)
    return base.join(marks, "doc", "left").mapInArrow(partial(_digests, length=length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
