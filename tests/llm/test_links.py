"""Components, n-gram links and embedding links against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import embeddings, graph, ngram_join


def closed(nodes, edges):
    top = {n: n for n in nodes}
    while True:
        new = dict(top)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == top:
            return top
        top = new


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(45)] + [(200, i) for i in range(201, 240)] + [(7, 7), (None, 3), (300, 301), (300, 301)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in graph.components(df).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == closed({x for e in real for x in e}, real)
    assert graph.components(df.limit(0)).count() == 0


def brute(rows, n, num, den):
    sets = defaultdict(list)
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets[key].append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    flat = [(k, s) for k, group in sets.items() for s in group if k is not None and s]
    edges = [(a, b) for i, (a, s) in enumerate(flat) for b, t in flat[:i] if den * len(s & t) >= num * len(s | t)]
    return {k: v for k, v in closed({k for k in sets if k is not None}, edges).items()}, sets


def corpus(seed, groups=6):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 5)))
    passage = " ".join(word() for _ in range(30))
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rnd.choice([5, 12, 40, 120]))]
        for _ in range(rnd.randint(1, 25)):
            text = list(base)
            for _ in range(rnd.randint(0, 4)):
                text[rnd.randrange(len(text))] = word()
            rows.append(" ".join(text) + (" " + passage if rnd.random() < 0.3 else ""))
    rows += [" ".join(word() for _ in range(rnd.randint(1, 60))) + " " + passage for _ in range(30)]
    rows += [word() for _ in range(20)]
    rnd.shuffle(rows)
    return [(10 * i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("n,num,den,block,seed", [(4, 85, 100, 1000, 1), (5, 80, 100, 2, 2), (2, 50, 100, 3, 3), (1, 100, 100, 1000, 4)])
def test_jaccard_equals_brute_force(docs, odd_rows, monkeypatch, n, num, den, block, seed):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus(seed) + [(-i if i is not None else None, t) for i, t in odd_rows]
    got = ngram_join.jaccard_join(docs(rows), n, num, den).collect()
    assert len(got) == len(rows)
    want, sets = brute(rows, n, num, den)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert any(len(s) == r["n_shingles"] for s in sets[r["doc_id"]])


def test_jaccard_empty(docs):
    assert ngram_join.jaccard_join(docs([])).count() == 0
    assert [tuple(r) for r in ngram_join.jaccard_join(docs([(1, None)])).collect()] == [(1, 0, 1)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, head int, n int")


@pytest.mark.parametrize("block", [1000, 4])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(block)
    x = []
    for g in range(25):
        c = rng.normal(size=24)
        x += [(c + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.12])).astype(np.float32) for _ in range(rng.integers(1, 20))]
    rows = [(i, v.tolist(), int(i % 3), 1, 1) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 0, 1, 1), (n + 1, [0.0] * 24, 0, 1, 1), (n + 2, [float("nan")] + [1.0] * 23, 0, 1, 1), (n + 3, [None] + [1.0] * 23, 0, 1, 1), (n + 4, x[0].tolist(), None, 1, 1), (n + 5, [], 0, 1, 1), (n + 6, [1.0, 2.0], 0, 1, 1), (n + 7, [2.0, 4.0], 0, 1, 1), (n + 8, [float("inf")] * 24, 1, 1, 1)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(vectors(spark, rows)).collect()}
    assert len(got) == len(rows)
    good = {i: (np.array(v, np.float64), lab) for i, v, lab, *_ in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    edges = []
    for i, (a, p) in good.items():
        for j, (b, q) in good.items():
            if i < j and p == q and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.98:
                edges.append((i, j))
    links = defaultdict(int)
    for i, j in edges:
        links[i] += 1
        links[j] += 1
    found, whole = sum(r["n_links"] for r in got.values()), 2 * len(edges)
    assert found >= 0.97 * whole and all(got[i]["n_links"] <= links[i] for i in got)
    top = closed(got, edges)
    assert np.mean([got[i]["component_id"] == top[i] for i in got]) >= 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert got[n + 7]["component_id"] == n + 6


def test_repeated_and_clashing_vectors(spark):
    a, b, c = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.0, 0.0, 1.0]
    rows = [(i, v, lab, 1, 1) for i, v, lab in [(1, a, 0), (1, a, 0), (2, a, 0), (3, b, 0), (4, c, 0), (4, c, 0), (5, a, 0), (5, c, 0), (6, a, 1), (5, a, 1), (None, a, 0), (9, None, 0), (9, None, 0)]]
    # 1, 2, 5 hold a; 3 is near them; 4 and 5 hold c; under label 1 both 6 and 5 hold a.
    want = [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 1, 1), (4, 1, 1), (5, 1, 1), (5, 1, 1), (5, 3, 1), (6, 1, 1), (9, 0, 9), (9, 0, 9), (None, 0, None)]
    for df in (vectors(spark, rows), vectors(spark, rows).repartition(5)):
        got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(vectors(spark, [])).count() == 0


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 16))
    h = np.array([[1.0]])
    for _ in range(4):
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(embeddings.hadamard(x), x @ h)
