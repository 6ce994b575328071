import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffixes


@pytest.mark.parametrize("letters", [1, 2, 3, 200])
def test_suffix_array(letters):
    rnd = random.Random(letters)
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 30, 200, 700):
        s = [rnd.randint(1, letters) for _ in range(n)]
        assert suffixes.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(n), key=lambda i: s[i:])


def brute(rows, length=100):
    seen, out = set(), {}
    for key, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (text or "").encode()
        marks, own = bytearray(len(b)), set()
        if key in out:
            continue
        for i in range(len(b) - length + 1):
            g = b[i : i + length]
            if g in seen or g in own:
                marks[i : i + length] = b"\1" * length
            own.add(g)
        seen |= own
        kept = bytes(c for c, m in zip(b, marks, strict=True) if not m)
        spans = sum(1 for i, m in enumerate(marks) if m and (not i or not marks[i - 1]))
        out[key] = len(b), sum(marks), spans, hashlib.sha256(kept).hexdigest()
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 8)))
    passages = [" ".join(word() for _ in range(rnd.randint(15, 60))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(rnd.randint(1, 4))]
        for _ in range(rnd.randint(0, 2)):
            p = rnd.choice(passages)
            parts.insert(rnd.randint(0, len(parts)), p if rnd.random() < 0.6 else p[rnd.randint(0, 40) :])
        text = " ".join(parts)
        if rows and rnd.random() < 0.2:
            text = rnd.choice(rows)[1]
            if rnd.random() < 0.6:
                at = rnd.randint(0, len(text))
                text = text[:at] + word() + text[at:]
        rows.append((i * 3, text))
    return rows + [(1000, "a" * 500), (1001, "ab" * 150), (1002, "b" + "a" * 250), (1003, None), (1004, ""), (1005, "z" * 99)]


@pytest.mark.parametrize("hot,block,piece", [(20_000, 1 << 21, 1 << 19), (2, 3000, 700)])
def test_equals_brute_force(docs, monkeypatch, hot, block, piece):
    monkeypatch.setattr(suffixes, "PER_BLOCK", hot)
    monkeypatch.setattr(suffixes, "BLOCK", block)
    rows = corpus(hot)
    monkeypatch.setattr(suffixes, "_PIECE", piece)
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffixes.repeated_spans(docs(rows)).collect()}
    assert got == brute(rows)


def test_odd_rows(docs, odd_rows):
    rows = suffixes.repeated_spans(docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    expected = brute([r for r in odd_rows if r[0] not in (4, 5)])
    for r in rows:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        elif r["doc_id"] not in (4, 5):
            assert tuple(r)[1:5] == expected[r["doc_id"]]
    long = {r["doc_id"]: r for r in rows}
    assert long[5]["n_removed"] == long[5]["n_bytes"] and long[5]["n_spans"] == 1
    # The first of the two repeats itself but for its first period and what overlaps it.
    assert long[4]["n_bytes"] - long[4]["n_removed"] == 11


def test_spans_cut_the_text(docs):
    shared = "".join(chr(97 + i * 7 % 26) + chr(97 + i // 26) for i in range(120))
    row = suffixes.repeated_spans(docs([(1, shared), (2, "head " + shared + " tail")])).where("doc_id = 2").first()
    assert [tuple(s) for s in row["spans"]] == [(5, 5 + len(shared))]


def test_empty_table(docs):
    assert suffixes.repeated_spans(docs([])).count() == 0
