"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .common import map_rows, reuse_memory, slices, worker_cache

#: The classifier is fitted on at most so many labelled rows of a class, in the order of their ids' hash. Of a fitted text with more bytes than
#: FIT_BYTES, pieces of FIT_PIECE bytes at even distances over all of it are read; texts that are scored are read whole.
FIT_TOXIC, FIT_ORDINARY, FIT_BYTES, FIT_PIECE = 1500, 3000, 32_768, 1024
#: Bytes of a window. One begins at each word, and every STRIDE bytes within a longer one, so they leave no byte out.
WINDOW, STRIDE = 32, 16
#: Bytes of ordinary text that both dictionaries end on, of raw text that first finds toxic windows, and of the trained parts of both.
SHARED, FIRST, TOXIC_PARTS, ORDINARY_PART = 200_000, 100_000, (8192, 4096, 4096), 8192
#: Bytes saved from which a window is a sample for the toxic part, round by round, and for the ordinary part; samples of ordinary text.
SAMPLED, COUNTER, ORDINARY_WINDOWS = (5, 5, 4), 2, 150_000
#: zstandard's level, and the segment and substring lengths of its dictionary training.
LEVEL, SEGMENT, PART = 3, 14, 8
#: Bytes of the dictionary of ordinary windows whose tables code the matches, and windows that train it.
HEAD, HEAD_WINDOWS = 1024, 20_000
#: Bytes saved by which windows are counted, alone and as a mean of NEAR neighbours.
SAVED, NEAR, MEANS = tuple(range(1, 9)), 5, (1, 1.6, 2.2, 2.8, 3.4, 4.2, 5)
FOLDS = 5
_GAP = re.compile(r"[\W_]+")
_CHUNK = 1 << 18


def plain(text: str | None) -> bytes:
    """Words in lower case with a space before each and at the end; nothing for a text without any."""
    words = _GAP.sub(" ", (text or "").lower()).strip(" ")
    return f" {words} ".encode() if words else b""


def windows(data: bytes) -> np.ndarray:
    """(start, length) of each window: it begins at a space, or STRIDE bytes after the last place where one did."""
    at = np.arange(len(data))
    last = np.maximum.accumulate(np.where(np.frombuffer(data, np.uint8) == 32, at, 0))
    start = at[:-1][(at - last)[:-1] % STRIDE == 0]
    return np.stack((start, np.minimum(WINDOW, len(data) - start)), 1).astype(np.uint64)


def spread(data: bytes) -> bytes:
    """All of it, or pieces at even distances from its beginning to its end."""
    if len(data) <= FIT_BYTES:
        return data
    n = FIT_BYTES // FIT_PIECE
    return b"".join(data[i * (len(data) - FIT_PIECE) // (n - 1) :][:FIT_PIECE] for i in range(n))


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    found = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_AUTO)
    found.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=found, compression_params=parameters)


def lengths(by: zstandard.ZstdCompressor, found) -> np.ndarray:
    """Compressed length of each window; `found` is a list of bytes, or a buffer with its segments."""
    return np.fromiter(map(len, by.multi_compress_to_buffer(found, threads=0)), np.int64) if len(found) else np.zeros(0, np.int64)


def cut(texts: list[bytes]) -> list[bytes]:
    return [t[a : a + n] for t in texts for a, n in windows(t).tolist()]


def trained(size: int, samples: list[bytes]) -> bytes:
    """zstandard's own dictionary of the samples; nothing if it finds them too few."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=PART).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def head(samples: list[bytes]) -> bytes:
    """What a dictionary begins with (RFC 8878, 5) so that its tables for matches are ready, where zstandard else builds three for every window: those it
    trains on the samples. Its table for literals is replaced by one of two symbols, so that bytes without a match are meant to stay as they are."""
    found = trained(HEAD, samples)
    if not found:
        return b""
    size = found[8] + 1 if found[8] < 128 else (found[8] - 126) // 2 + 1
    return found[:8] + b"\x80\x10" + found[8 + size :]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary.

    Both begin with the same tables and hold the same ordinary text, so that a window of it compresses to equal lengths, and before the window (nearest, so cheapest) a part of their own
    that zstandard trains. The samples of the toxic part are the windows of toxic texts that it makes shorter than ordinary text does: first by
    raw text of the other half of the toxic texts, then by the part trained before. Those of the ordinary part are the windows of
    ordinary texts that the toxic part makes shorter, so what only chance put there counts for nothing.
    """
    rnd = random.Random(1)
    order = rnd.sample(ordinary, len(ordinary))
    text = b"".join(order)
    shared, other = text[:SHARED], text[SHARED:][:FIRST] or text[:FIRST]
    halves = toxic[::2], toxic[1::2]
    mine = [cut(h) for h in halves]
    theirs = cut(order)
    theirs = rnd.sample(theirs, min(len(theirs), ORDINARY_WINDOWS))
    shared = head(theirs[:HEAD_WINDOWS]) + shared
    with_ = lambda part: compressor(shared + part)
    raw = [b"".join(h)[:FIRST] for h in reversed(halves)]
    saved = [lengths(with_(other[: len(r)]), m) - lengths(with_(r), m) for m, r in zip(mine, raw, strict=True)]
    bad = good = b""
    for size, least in zip(TOXIC_PARTS, SAMPLED, strict=True):
        bad = trained(size, [w for m, s in zip(mine, saved, strict=True) for w, x in zip(m, s.tolist(), strict=True) if x >= least])
        by = with_(bad)
        gain = lengths(with_(good), theirs) - lengths(by, theirs)
        good = trained(ORDINARY_PART, [w for w, x in zip(theirs, gain.tolist(), strict=True) if x >= COUNTER])
        against = with_(good)
        saved = [lengths(against, m) - lengths(by, m) for m in mine]
    return shared + bad, shared + good


def features(saved: np.ndarray) -> list[float]:
    """Of the bytes saved by the toxic dictionary, window by window: how many windows pass each threshold (log) and their share, alone and as means
    of neighbours; the sum of what is saved, its balance, and the number of windows."""
    n = len(saved)
    near = np.convolve(saved, np.ones(NEAR) / NEAR, "same") if n >= NEAR else saved
    out = []
    for values, steps in ((saved, SAVED), (near, MEANS)):
        for least in steps:
            passed = int(np.count_nonzero(values >= least - 1e-9))
            out += [np.log1p(passed), 20 * passed / (n + 20)]
    return [*out, np.log1p(np.maximum(saved, 0).sum()), float(np.clip(saved, -4, 9).sum()) / (n + 20), np.log1p(n) / 5]


@dataclass
class Model:
    """Both dictionaries, and the calibration: weights of the standardised features and the offset."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def key(self) -> str:
        return xxhash.xxh3_128_hexdigest(b"\0".join((self.toxic, self.ordinary)))


class Scorer:
    def __init__(self, model: Model):
        reuse_memory()
        self.model, self.toxic, self.ordinary = model, compressor(model.toxic), compressor(model.ordinary)

    def saved(self, texts: list[bytes]) -> list[np.ndarray]:
        """Bytes that the toxic dictionary saves in each window of each text. Many short texts are compressed in one call, a long one in
        several; the windows are the same, and none is of two texts."""
        places = [windows(t) if t else np.zeros((0, 2), np.uint64) for t in texts]
        data, place = b"".join(texts), np.concatenate([np.zeros((0, 2), np.uint64), *places])
        shift = np.cumsum([0, *map(len, texts[:-1])]).astype(np.uint64)
        place[:, 0] += np.repeat(shift, [len(p) for p in places])
        out = [np.zeros(0, np.int64)]
        for a in range(0, len(place), _CHUNK // STRIDE):
            part = place[a : a + _CHUNK // STRIDE].copy()
            first, last = int(part[0, 0]), int(part[-1].sum())
            part[:, 0] -= np.uint64(first)
            found = zstandard.BufferWithSegments(data[first:last], part.tobytes())
            out.append(lengths(self.ordinary, found) - lengths(self.toxic, found))
        return np.split(np.concatenate(out), np.cumsum([len(p) for p in places])[:-1])

    def features(self, texts: list[bytes]) -> Iterator[list[float]]:
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= _CHUNK:
                yield from map(features, self.saved(held))
                held, size = [], 0
        if held:
            yield from map(features, self.saved(held))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """0 for a text without words."""
        data, m = [plain(t) for t in texts], self.model
        x = (np.array(list(self.features(data))).reshape(len(data), -1) - m.mean) / m.spread
        z = np.clip(np.einsum("ij,j->i", x, m.weights[:-1]) + m.weights[-1], -500, 500)
        return np.where([len(d) > 0 for d in data], 1 / (1 + np.exp(-z)), 0.0)

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights of a logistic regression, by Newton's steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, hold = np.zeros(a.shape[1]), np.array([1.0] * (a.shape[1] - 1) + [1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(hold), a.T @ (p - y) + hold * w)
        w -= step * min(1, 2 / max(1e-12, np.abs(step).max()))
    return mean, scale, w


def fit(toxic: list[bytes], ordinary: list[bytes], odds: float | None = None) -> Model | None:
    """Dictionaries of all texts (from `plain`); thresholds and weights from lengths under dictionaries of the half that a text is not in. `odds` is how many
    toxic rows there are to an ordinary one, where the texts given are not in that proportion. None without two texts of each class."""
    toxic, ordinary = [t for t in toxic if t], [t for t in ordinary if t]
    if len(toxic) < 2 or len(ordinary) < 2:
        return None
    rows, marks = [], []
    for i in (0, 1):
        scorer = Scorer(Model(*dictionaries(toxic[i::2], ordinary[i::2])))
        for mark, side in ((1.0, toxic[1 - i :: 2]), (0.0, ordinary[1 - i :: 2])):
            rows += scorer.features(side)
            marks += [mark] * len(side)
    mean, scale, weights = calibrate(np.array(rows), np.array(marks))
    if odds:
        weights[-1] += np.log(odds * len(ordinary) / len(toxic))
    return Model(*dictionaries(toxic, ordinary), mean, scale, weights)


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [spread(plain(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("toxic"), pa.array(found, pa.binary())], names=["doc", "toxic", "sample"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fits on labelled rows outside the held-out fold. What comes to the driver is bounded by the FIT parameters above.

    Of rows that share an id, the least text stands for it, and a label of 1 wins.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc"), F.col("toxic").cast("int").alias("toxic")).where("doc is not null and toxic in (0, 1)").where(~held_out(F.col("doc")))
    known = known.groupBy("doc").agg(F.max("toxic").alias("toxic"))
    part = lambda k, n: known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc"), "doc").limit(n)
    chosen = part(1, FIT_TOXIC).unionByName(part(0, FIT_ORDINARY))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(chosen), "doc").groupBy("doc", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(rows.mapInArrow(_samples, "doc long, toxic int, sample binary").collect(), key=lambda r: r["doc"])
    ill, all_ = known.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    return fit([bytes(r["sample"]) for r in rows if r["toxic"]], [bytes(r["sample"]) for r in rows if not r["toxic"]], ill / max(1, all_ - ill))


def _scored(batches: Iterator[pa.RecordBatch], model: Model | None, place: int, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.zeros(batch.num_rows)
        if model is not None and batch.num_rows:
            scorer = worker_cache(("toxicity", model.key), lambda: Scorer(model))
            score = scorer.scores(batch.column(place).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, name])


def with_score(docs: DataFrame, model: Model | None, name: str, text_col: str = "text") -> DataFrame:
    """docs with a column `name`, 0 to 1. Null, empty and blank texts and those without a letter or digit score 0; without a model every score is 0."""
    if name in docs.columns:
        raise ValueError(f"{name} is a column already")
    run = partial(_scored, model=model, place=docs.columns.index(text_col), name=name)
    return map_rows(docs, run, (StructField(name, DoubleType()),))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) a row, scored on the whole text; rows of equal id are scored each; a null id is not held out."""
    model = learn(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = with_score(rows, model, "score")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
