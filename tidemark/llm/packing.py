"""Packing by power-of-two decomposition: pieces of binary lengths, equal lengths in a bucket, no sequence with two documents."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, worker_cache

LONGEST, END, MEMORY = 2048, 1, 300_000
#: White space in Python that the tokenizer's pattern does not take for it, and what stands for a word's end below.
CONTROLS = "\0\x1c\x1d\x1e\x1f"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary())])


class Words:
    """Ids of runs without white space, remembered within a bounded memory.

    The tokenizer's pattern never crosses white space, so each run can be encoded apart. A run that is new is cut by the pattern, and all new ones of a
    batch are merged in one call: the vocabulary's merges as ranks of bytes, with a zero byte for a word's end. The vocabulary file gives
    pattern, merges and ids. A text with an added token's string in it, or with characters on which Unicode versions differ, goes to the library
    as it is, and so does every text if the file is of another shape.
    """

    def __init__(self, path: str):
        self.path, self.memo, self.known, self.strange = path, {}, set(), set()
        with open(path, encoding="utf-8") as f:
            self.fast = self.ranked(json.load(f))

    def ranked(self, file: dict) -> bool:
        """Prepares the merges; False if the file is not a lower-casing byte-level BPE with word ends."""
        import tiktoken

        model, steps = file["model"], [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        cutter = (file["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or steps != ["NFC", "Replace", "Lowercase"] or cutter[0].get("type") != "Split" or not cutter[0].get("invert"):
            return False
        plain = {c: bytes([b]) for b, c in byte_characters().items()}
        raw = lambda t: b"".join(plain[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>")
        vocab = model["vocab"]
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 0]): 256 + b for b in range(256)}
        self.ids = np.zeros(512 + len(model["merges"]), np.uint32)
        for b, c in byte_characters().items():
            self.ids[b], self.ids[256 + b] = vocab[c], vocab[c + "</w>"]
        for i, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            token = raw(a) + raw(b)
            if token in ranks:
                return False
            ranks[token] = 512 + i
            self.ids[512 + i] = vocab[a + b]
        self.cut = regex.compile(cutter[0]["pattern"]["Regex"] + "| ")
        self.controls, self.odd, self.added = re.compile(f"[{CONTROLS}]"), re.compile(odd_characters()), [t["content"] for t in file["added_tokens"]]
        self.bpe = tiktoken.Encoding("words", pat_str="[^\\x00]*\\x00", mergeable_ranks=ranks, special_tokens={})
        return True

    @cached_property
    def tokenizer(self):
        """The library's own, loaded only where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def learn(self, words: set[str]) -> None:
        """Puts what the words lack into the memo, which is emptied first where it would grow past MEMORY."""
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMORY:
            self.memo.clear()
            new = list(words)
        for i in range(0, len(new), 8192):
            part = new[i : i + 8192]
            text = unicodedata.normalize("NFC", " ".join(part)).replace("\u03a3", "\u03c3").lower()
            found = np.array(self.bpe.encode_ordinary("\0".join(self.cut.findall(text)) + "\0"), np.uint32)
            # A space is a piece of its own, so its id marks where the next run begins.
            ends = np.flatnonzero(found == 256 + 32).tolist()
            ids = memoryview(self.ids[found].astype("<u4").tobytes())
            start = 0
            for word, end in zip(part, [*ends, len(found)], strict=True):
                self.memo[word] = bytes(ids[4 * start : 4 * end])
                start = end + 1

    def plain(self, texts: list[str]) -> list[bool]:
        """Which texts hold nothing that only the library reads rightly. A character is looked up once."""
        wide = [not t.isascii() for t in texts]
        new = set().union(*(t for t, w in zip(texts, wide, strict=True) if w)) - self.known
        strange = {c for c in new if self.odd.match(c)}
        self.known |= new - strange
        if not strange and not self.strange:
            wide = [False] * len(texts)
        self.strange |= strange
        return [not (w and not self.strange.isdisjoint(t)) and not self.controls.search(t) and not any(x in t for x in self.added) for t, w in zip(texts, wide, strict=True)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian 32-bit words."""
        words = [t.split() if plain else None for t, plain in zip(texts, self.plain(texts) if self.fast else [False] * len(texts), strict=True)]
        self.learn(set().union(*(w for w in words if w)))
        for text, own in zip(texts, words, strict=True):
            if own is None:
                yield np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield b"".join([self.memo[w] for w in own])


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself where it prints in Latin-1, else 256 and on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def odd_characters() -> str:
    """A pattern's class: CONTROLS, characters that Python's Unicode does not know yet, and marks that came after Unicode 3.2. The library's tables are
    of other versions, so it may lower-case the first and reorder the second where Python does not; of all others case and order are settled.
    """
    kind, old = unicodedata.category, unicodedata.ucd_3_2_0.category
    odd = np.array([kind(c) == "Cn" or kind(c)[0] == "M" and old(c) == "Cn" or c in CONTROLS for c in map(chr, range(0x110000))])
    edge = np.flatnonzero(np.diff(np.concatenate(([False], odd, [False])).view(np.int8))).tolist()
    return "[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edge[::2], edge[1::2], strict=True)) + "]"


def encode(texts: list[str], path: str) -> Iterator[bytes]:
    return worker_cache(("packing", path), lambda: Words(path)).encode(texts)


def binary_pieces(n: int, longest: int = LONGEST) -> list[int]:
    """n as lengths of at most `longest`, powers of two, longest first."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def pieces(docs: DataFrame, path: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, bucket (the length's power of two), ids, sequence_id, offset.

    Every document ends with id 1; null text is empty, so it has that id alone. Each piece is a sequence: its length is a power of two, so no
    sequence needs padding or holds two documents. Rows of equal id are packed apart. Sequence ids are unique, not dense.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            keys, starts, lengths, sums, totals, ids = [], [], [], [], [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for key, found in zip(batch.column("doc_id").to_pylist(), encode(texts, path), strict=True):
                words = memoryview(found + END.to_bytes(4, "little"))
                total, start = len(words) // 4, 0
                for n in binary_pieces(total):
                    piece = words[4 * start : 4 * (start + n)]
                    keys.append(key)
                    starts.append(start)
                    lengths.append(n)
                    sums.append(zlib.crc32(piece))
                    totals.append(total)
                    ids.append(bytes(piece) if with_ids else None)
                    start += n
            bucket = [n.bit_length() - 1 for n in lengths]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((keys, starts, lengths, sums, totals, bucket, ids), SCHEMA.types, strict=True)], schema=SCHEMA)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids binary")
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """A folder a length, for batches of equal sequences."""
    packed.write.partitionBy("bucket").parquet(path)
