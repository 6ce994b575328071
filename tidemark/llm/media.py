"""Media columns: storing bytes as 8-bit samples, signature sniffing, type correction, carving."""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, slices

UNIT = 192
RATE = 8000
#: Magic bytes of the formats that are looked for, with the MIME type that a valid hit gives.
MAGIC = {
    b"RIFF": "riff",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
    b"%PDF-": "application/pdf",
    b"fLaC": "audio/flac",
    b"OggS": "audio/ogg",
}


def wav(payload: bytes) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono samples, one a byte; RIFF pads an odd data chunk."""
    pad = b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + pad


def _riff(data: bytes, at: int) -> tuple[str, int] | None:
    if at + 12 > len(data):
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(data[at + 8 : at + 12])
    if kind is None or end > len(data):
        return None
    pos, names = at + 12, set()
    while pos + 8 <= end:
        names.add(data[pos : pos + 4])
        pos += 8 + (size := struct.unpack_from("<I", data, pos + 4)[0]) + (size & 1)
    needs = {"audio/wav": {b"fmt ", b"data"}, "image/webp": set(), "video/avi": {b"LIST"}}[kind]
    return (kind, end) if pos == end and needs <= names else None


def _png(data: bytes, at: int) -> tuple[str, int] | None:
    pos = at + 8
    while pos + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, pos)
        stop = pos + 12 + size
        if stop > len(data) or (pos == at + 8 and name != b"IHDR") or zlib.crc32(data[pos + 4 : stop - 4]) != struct.unpack_from(">I", data, stop - 4)[0]:
            return None
        if name == b"IEND":
            return "image/png", stop
        pos = stop
    return None


def _gif(data: bytes, at: int) -> tuple[str, int] | None:
    if at + 13 > len(data):
        return None
    flags = data[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while pos < len(data):
        mark = data[pos]
        if mark == 0x3B:
            return "image/gif", pos + 1
        if mark == 0x21:
            pos += 2
        elif mark == 0x2C and pos + 10 < len(data):
            pos += 11 + (3 << ((data[pos + 9] & 7) + 1) if data[pos + 9] & 0x80 else 0)
        else:
            return None
        while pos < len(data) and data[pos]:
            pos += 1 + data[pos]
        pos += 1
    return None


def _jpeg(data: bytes, at: int) -> tuple[str, int] | None:
    pos, framed = at + 2, False
    while pos + 4 <= len(data) and data[pos] == 0xFF:
        mark, size = data[pos + 1], struct.unpack_from(">H", data, pos + 2)[0]
        if size < 2:
            return None
        framed |= 0xC0 <= mark <= 0xC2
        pos += 2 + size
        if mark == 0xDA:
            end = data.find(b"\xff\xd9", pos)
            return ("image/jpeg", end + 2) if framed and end >= 0 else None
    return None


def _bmp(data: bytes, at: int) -> tuple[str, int] | None:
    if at + 30 > len(data):
        return None
    size, spare, start, header = struct.unpack_from("<IIII", data, at + 2)
    planes, bits = struct.unpack_from("<HH", data, at + 26)
    good = spare == 0 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and header in (40, 52, 56, 108, 124) and 14 + header <= start <= size and at + size <= len(data)
    return ("image/bmp", at + size) if good else None


class Marks:
    """Where a mark stands in the data: listed once, so that many openings before one end cost no search each."""

    def __init__(self, data: bytes):
        self.data, self.known = data, {}

    def after(self, mark: bytes, at: int) -> int:
        """The first place from `at` on, or -1."""
        if mark not in self.known:
            self.known[mark] = [m.start() for m in re.finditer(b"(?=" + re.escape(mark) + b")", self.data)]
        i = bisect.bisect_left(self.known[mark], at)
        return self.known[mark][i] if i < len(self.known[mark]) else -1


def _zip(data: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    end = marks.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return None
    count, size, start, note = struct.unpack_from("<HIIH", data, end + 10)
    return ("application/zip", end + 22 + note) if count and at + start + size == end and end + 22 + note <= len(data) else None


def _gzip(data: bytes, at: int) -> tuple[str, int] | None:
    """Inflates in steps of 64 KiB, so a bomb takes no more memory than a step; its trailer's checksum must hold."""
    inflate, pos = zlib.decompressobj(31), at
    try:
        while not inflate.eof:
            feed = inflate.unconsumed_tail
            if not feed:
                feed, pos = data[pos : pos + 65536], pos + 65536
                if not feed:
                    return None
            inflate.decompress(feed, 65536)
    except zlib.error:
        return None
    return "application/gzip", min(pos, len(data)) - len(inflate.unused_data)


def _pdf(data: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    end = marks.after(b"%%EOF", at)
    return ("application/pdf", end + 5) if end >= 0 and 0 <= marks.after(b"startxref", at) <= end - 9 else None


def _flac(data: bytes, at: int) -> tuple[str, int] | None:
    pos, last = at + 4, False
    while not last:
        if pos + 4 > len(data) or (pos == at + 4 and data[pos] & 127):
            return None
        last, size = data[pos] > 127, int.from_bytes(data[pos + 1 : pos + 4], "big")
        if pos == at + 4 and size != 34:
            return None
        pos += 4 + size
    return ("audio/flac", len(data)) if pos <= len(data) else None


def _ogg(data: bytes, at: int) -> tuple[str, int] | None:
    pos = at
    while data[pos : pos + 5] == b"OggS\0" and pos + 27 <= len(data):
        count = data[pos + 26]
        pos += 27 + count + sum(data[pos + 27 : pos + 27 + count])
    return ("audio/ogg", pos) if at < pos <= len(data) else None


VALIDATORS = {"riff": _riff, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/gzip": _gzip, "audio/flac": _flac, "audio/ogg": _ogg}
#: Those whose end is a mark further on.
MARKED = {"application/zip": _zip, "application/pdf": _pdf}
_automaton = None


def automaton() -> ahocorasick.Automaton:
    """The magic bytes as an Aho-Corasick automaton; bytes are read as Latin-1, a character each."""
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for magic, kind in MAGIC.items():
            _automaton.add_word(magic.decode("latin-1"), (len(magic), kind))
        _automaton.make_automaton()
    return _automaton


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, type) of each valid file in data, by start; a file inside another one comes after it."""
    found, marks = [], Marks(data)
    for last, (size, kind) in automaton().iter(data.decode("latin-1")):
        start = last - size + 1
        if hit := MARKED[kind](data, start, marks) if kind in MARKED else VALIDATORS[kind](data, start):
            found.append((start, hit[1], hit[0]))
    return sorted(set(found), key=lambda x: (x[0], -x[1]))


def samples(data: bytes, start: int) -> bytes:
    """The sample bytes of the WAV file that begins at start."""
    pos = start + 12
    while data[pos : pos + 4] != b"data":
        size = struct.unpack_from("<I", data, pos + 4)[0]
        pos += 8 + size + (size & 1)
    return data[pos + 8 : pos + 8 + struct.unpack_from("<I", data, pos + 4)[0]]


def padded(data: bytes) -> bytes:
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("declared", pa.string()), ("media", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media_type", pa.string()), ("corrected", pa.bool_()), ("carved", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("media_type", pa.string())])))])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "application/octet-stream") -> DataFrame:
    """(doc_id, n_bytes, declared, media): each whole text (null: empty), padded with spaces to a positive multiple of 192 bytes, as a WAV file.

    A row comes out for each row in, repeated ids too; other columns are left out; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 23):
            raw = [x or b"" for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array([declared] * len(raw)), pa.array([wav(padded(x)) for x in raw], pa.binary())], schema=MEDIA)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, sign changes about the mean, and a 16-bin histogram: equal bytes, equal text."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    mean = float(x.mean())
    return f"mean={mean:.4f};std={float(x.std()):.4f};crossings={int(np.count_nonzero(np.diff(x > mean)))};hist={','.join(map(str, bins.tolist()))}"


def read_back(media: DataFrame) -> DataFrame:
    """Sniffs the stored bytes, corrects the declared type, carves files inside, and reads payload and features from the samples.

    Null media counts as no bytes. Bytes in which no WAV file begins give null payload columns and feature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 1 << 23):
            out = []
            for key, n, declared, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "declared", "media")), strict=True):
                data = data or b""
                hits = sniff(data)
                kind = next((k for a, _, k in hits if a == 0), None)
                payload = samples(data, 0) if kind == "audio/wav" else None
                inner = [{"start": a, "length": b - a, "media_type": k} for a, b, k in hits if a]
                row = [key, n, *([None] * 3 if payload is None else [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])]), len(data), hashlib.sha256(data).hexdigest(), None if not payload else feature(payload), kind or declared, kind is not None and kind != declared, inner]
                out.append(dict(zip(READ.names, row, strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema=READ)

    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean, carved array<struct<start:long,length:long,media_type:string>>")
