"""Byte-level BPE as a monoid: halves are encoded apart and joined at the boundary alone."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded_batches, slices, worker_cache

LEAF, MEMORY = 24, 400_000
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class TreeBPE:
    """Encodes bytes by merge ranks.

    A sequence of tokens, each of which encodes to itself, is the encoding of their bytes if and only if each two neighbours
    encode to themselves: the first merge across a token's end would happen in that pair alone as well, as until then
    only merges inside tokens have happened. So two encodings join by re-encoding the last k and first k tokens, with
    k doubled until both seams of the new window are stable in this sense; the rest cannot change.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.stable = lru_cache(1 << 16)(self._stable)

    def leaf(self, data: bytes) -> list[int]:
        """Merges of the lowest rank first, leftmost among equals; for short input."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _stable(self, a: int, b: int) -> bool:
        return self.tree(self.bytes[a] + self.bytes[b]) == [a, b] if len(self.bytes[a]) + len(self.bytes[b]) > 2 * LEAF else self.leaf(self.bytes[a] + self.bytes[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left or right
        k = 1
        while True:
            tail, head = left[-k:], right[:k]
            middle = self.leaf(b"".join(self.bytes[t] for t in (*tail, *head)))
            before, after = left[:-k], right[k:]
            if (not before or self.pair(before[-1], middle[0])) and (not after or self.pair(middle[-1], after[0])):
                return before + middle + after
            k *= 2

    def pair(self, a: int, b: int) -> bool:
        return self.stable(a, b) if len(self.bytes[a]) + len(self.bytes[b]) <= 2 * LEAF else self.leaf(self.bytes[a] + self.bytes[b]) == [a, b]

    def tree(self, data: bytes) -> list[int]:
        """Bottom up, so that depth costs no stack."""
        runs = [self.leaf(data[i : i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(runs) > 1:
            runs = [self.join(runs[i], runs[i + 1]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
        return runs[0] if runs else []

    def encode(self, piece: bytes) -> list[int]:
        """One match of the pattern: a token of its own if the vocabulary has it, else the tree's."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tree(piece)

    def decode(self, ids: list[int]) -> bytes:
        """Neighbours are joined level by level."""
        parts = [self.bytes[i] for i in ids]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 64]) for i in range(0, len(parts), 64)]
        return parts[0] if parts else b""


class Memo(dict):
    """Pieces seen before: (ids as text, decoded bytes, count); emptied when it holds MEMORY of them, so its size is bounded."""

    def __init__(self, bpe: TreeBPE):
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[str, bytes, int]:
        ids = self.bpe.encode(piece.encode())
        found = ",".join(map(str, ids)), self.bpe.decode(ids), len(ids)
        if len(piece) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = found
        return found


def loaded(path: str, pattern: str) -> tuple:
    """Once a worker: the compiled pattern and the memo."""
    return worker_cache(("bpe", path, pattern), lambda: (regex.compile(pattern), Memo(TreeBPE(load_ranks(path)))))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: number of ids, hash of the ids, hash of the bytes decoded from them. Null text counts as empty; rows of equal id stay apart.

    `path` must be readable on every executor (a vocabulary file installed there).
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, memo = loaded(path, pattern)
        for batch in slices(batches, "text", 1 << 23):
            out = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids, raw, n, some = hashlib.sha256(), hashlib.sha256(), 0, False
                # Pieces go to the hashes in runs, so a long text never has all its ids in memory at once.
                pieces = compiled.findall(text or "") if len(text or "") < 1 << 22 else None
                for run_of in [pieces] if pieces is not None else chunks(compiled, text):
                    if run_of:
                        got = [memo[p] for p in run_of]
                        ids.update(("," * some + ",".join([g[0] for g in got])).encode())
                        raw.update(b"".join([g[1] for g in got]))
                        n, some = n + sum([g[2] for g in got]), True
                out.append((key, n, ids.hexdigest(), raw.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def chunks(compiled, text: str, size: int = 100_000) -> Iterator[list[str]]:
    run: list[str] = []
    for m in compiled.finditer(text):
        run.append(m.group())
        if len(run) == size:
            yield run
            run = []
    yield run
