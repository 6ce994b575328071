import gzip
import hashlib
import io
import time
import zipfile
import zlib

import numpy as np
import pytest

from tidemark.llm import media


def png():
    chunk = lambda n, d: len(d).to_bytes(4, "big") + n + d + zlib.crc32(n + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", zlib.compress(b"\0")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes(8) + b"\0" + b"\x02\x02\x44\x01\x00" + b"\x3b"
SAMPLES = {"image/png": png(), "application/zip": zipped(), "application/gzip": gzip.compress(b"data" * 50), "image/gif": GIF, "audio/wav": media.wav(b"abcd")}


@pytest.mark.parametrize("kind", SAMPLES)
def test_found_whole_and_carved(kind):
    data = SAMPLES[kind]
    assert media.sniff(data)[0] == (0, len(data), kind)
    held = b"junk PK\x03\x04 BM RIFF" + data + b"more"
    assert (17, 17 + len(data), kind) in media.sniff(held)


@pytest.mark.parametrize("kind", SAMPLES)
def test_cut_files_do_not_count(kind):
    data = SAMPLES[kind]
    assert all(k != kind for _, _, k in media.sniff(data[: len(data) // 2]))


def test_broken_checksum():
    data = bytearray(png())
    data[20] ^= 1
    assert media.sniff(bytes(data)) == []


def test_many_openings_without_an_end():
    began = time.perf_counter()
    assert media.sniff(b"PK\x03\x04%PDF-1.4 " * 60_000) == []
    assert time.perf_counter() - began < 5


def test_round_trip(spark, docs, odd_rows):
    rows = media.read_back(media.store(docs(odd_rows))).collect()
    assert len(rows) == len(odd_rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for key, text in odd_rows:
        raw = (text or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert any(r["n_bytes"] == len(raw) and r["payload_bytes"] == len(full) and r["payload_sha256"] == hashlib.sha256(full).hexdigest() and r["tail_crc32"] == zlib.crc32(full[-16:]) and r["media_sha256"] == hashlib.sha256(media.wav(full)).hexdigest() for r in by[key])
    assert all(r["media_type"] == "audio/wav" and r["corrected"] for r in rows)
    assert by[10][0]["feature"] == by[11][0]["feature"]


def test_text_that_holds_a_file(spark, docs):
    row = media.read_back(media.store(docs([(1, "see " + GIF[:-1].decode("latin-1")), (2, "fake RIFF WAVE")]))).where("doc_id = 2").first()
    assert row["carved"] == [] and row["media_type"] == "audio/wav"


def test_other_bytes(spark):
    df = spark.createDataFrame([(1, 3, "image/png", bytearray(png())), (2, 0, "text/plain", None), (3, 4, "a/b", bytearray(b"zzzz"))], "doc_id long, n_bytes long, declared string, media binary")
    got = {r["doc_id"]: r for r in media.read_back(df).collect()}
    assert (got[1]["media_type"], got[1]["corrected"], got[1]["payload_bytes"]) == ("image/png", False, None)
    assert (got[2]["media_type"], got[3]["corrected"]) == ("text/plain", False)


def test_empty_table(docs):
    assert media.read_back(media.store(docs([]))).count() == 0


def test_odd_payload():
    assert media.samples(media.wav(b"abc"), 0) == b"abc"
    assert media.feature(b"aaaa") == media.feature(bytes(np.frombuffer(b"aaaa", np.uint8)))
