"""Recommenders against brute force over whole matrices."""

import random

import duckdb
import numpy as np
import pytest

from tidemark import plans
from tidemark.operators import recommenders as R
from tidemark.operators.sparse import random_zeros


def matrix(spark, cells):
    return spark.createDataFrame([(r, c, float(v)) for (r, c), v in cells.items()], "row long, col long, value double")


def dense(cells):
    m = np.zeros((max(r for r, _ in cells) + 1, max(c for _, c in cells) + 1))
    for at, v in cells.items():
        m[at] = v
    return m


@pytest.mark.parametrize("k", [1, 4, 40])
def test_euclidean_equals_all_pairs(spark, k):
    rnd = random.Random(2)
    cells = {(rnd.randrange(40), c): rnd.choice([1, 2, 3, 9]) for c in range(25) for _ in range(rnd.randint(1, 4))}
    m = dense(cells)
    want = set()
    for j in range(25):
        near = sorted((float(((m[:, i] - m[:, j]) ** 2).sum()), i) for i in range(25) if i != j)
        want |= {(i, j, round(1 / (d**0.5 + 1e-9), 6)) for d, i in near[:k]}
    assert {(r["i"], r["j"], round(r["value"], 6)) for r in R.euclidean(matrix(spark, cells), k).collect()} == want


def weights(g, l1, l2, j):
    """Projected gradient over all other items, to the end."""
    others = [i for i in range(len(g)) if i != j]
    m, y = g[np.ix_(others, others)], g[others, j]
    w, step = np.zeros(len(y)), 1 / (np.linalg.eigvalsh(m)[-1] + l2)
    for _ in range(20_000):
        w = np.maximum(0, w + step * (y - m @ w - l2 * w - l1))
    return dict(zip(others, w, strict=True))


@pytest.mark.parametrize("signed", [False, True])
def test_slim_sees_every_item(spark, signed):
    # More co-occurring items than the twenty that a regression once saw.
    rnd = random.Random(4)
    cells = {(u, c): 1 for u in range(60) for c in range(30) if rnd.random() < 0.9 / (1 + c / 12)}
    cells |= {(u, 29): 1 for u in range(60) if (u, 28) in cells}
    if signed:
        cells = {at: -1 if sum(at) % 5 == 0 else 1 for at in cells}
    m = dense(cells)
    for k in (30, 3):
        got = {(r["i"], r["j"]): r["value"] for r in R.slim(matrix(spark, cells), 0.5, 1.0, k).collect()}
        for j in range(30):
            w = weights(m.T @ m, 0.5, 1.0, j)
            top = sorted((i for i in w if w[i] > 1e-7), key=lambda i: -w[i])[:k]
            mine = {i: v for (i, t), v in got.items() if t == j and v > 1e-7}
            assert mine == pytest.approx({i: w[i] for i in top}, abs=1e-6)


def test_slim_refuses_dense(spark, monkeypatch):
    monkeypatch.setattr(R, "DENSE_LIMIT", 1)
    with pytest.raises(ValueError):
        R.slim(matrix(spark, {(0, 0): 1, (0, 1): 1}), 0.5, 1.0, 5)


def test_models_read_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT l_suppkey, p_size, sum(l_quantity)::DOUBLE FROM '{d}/lineitem.parquet' JOIN '{d}/part.parquet' ON l_partkey = p_partkey GROUP BY ALL").fetchall()
    cells = {(r, c): v for r, c, v in rows}
    run = lambda name: plans.QUERIES[name](spark, d).collect()
    m = dense(cells)
    ids = sorted({c for _, c in cells})
    m = m[sorted({r for r, _ in cells})][:, ids]
    assert {(r["row"], r["col"]) for r in run("r19_nonnegative_factors")} == set(cells)
    p = np.linalg.inv(m.T @ m + 100 * np.eye(len(ids)))
    b = p / -np.diag(p)
    got = run("r16_ease_r")
    assert len(got) == 10 * len(ids)
    assert [r["value"] for r in got] == pytest.approx([b[ids.index(r["i"]), ids.index(r["j"])] for r in got])
    v = np.linalg.svd(m)[2][:8].T
    scores, rows = m @ v @ v.T, sorted({r for r, _ in cells})
    got = run("r17_pure_svd")
    assert len(got) == scores.size and all(abs(scores[rows.index(r["row"]), ids.index(r["col"])] - r["value"]) < 1e-6 * (1 + abs(r["value"])) for r in got)
    ones = (m > 300).astype(float)
    used = [i for i in range(len(ids)) if ones[:, i].any()]
    g = ones[:, used].T @ ones[:, used]
    got = {(r["i"], r["j"]): r["value"] for r in run("r21_slim")}
    for j in range(len(used)):
        w = sorted(weights(g, 0.5, 1.0, j).values(), reverse=True)[:10]
        assert sorted((v for (_, t), v in got.items() if t == ids[used[j]] and v > 1e-7), reverse=True) == pytest.approx([v for v in w if v > 1e-7], abs=1e-5)


def test_pure_svd_equals_numpy(spark):
    rnd = random.Random(6)
    cells = {(rnd.randrange(30), rnd.randrange(12)): rnd.choice([1, 2, 5]) for _ in range(200)} | {(r, 11): 3 for r in range(3)}
    m = dense(cells)
    x = matrix(spark, cells)
    factors = R.pure_svd(spark, x, 4)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    got = np.array([r["vector"] for r in sorted(factors.collect(), key=lambda r: r["col"])])
    for mine, theirs in zip(got.T, vt[:4], strict=True):
        assert np.allclose(mine, theirs, atol=1e-8) or np.allclose(mine, -theirs, atol=1e-8)
    want = (u[:, :4] * s[:4]) @ vt[:4]
    assert all(abs(want[r["row"], r["col"]] - r["value"]) < 1e-8 for r in R.svd_scores(x, factors).collect())


@pytest.mark.parametrize("per_row", [1, 3, 50])
def test_random_zeros_are_as_many_as_asked(spark, per_row):
    rnd = random.Random(8)
    ids = [rnd.randrange(10**6) for _ in range(20)]
    cells = {(r, c) for r in range(12) for c in ids if rnd.random() < r / 11}
    m = spark.createDataFrame([(r, c, 1.0) for r, c in cells], "row long, col long, value double")
    held = {c for _, c in cells}
    got = random_zeros(m, per_row, 5).collect()
    assert len({(r["row"], r["col"]) for r in got}) == len(got) and all((r["row"], r["col"]) not in cells and r["col"] in held for r in got)
    for row in {r for r, _ in cells}:
        free = len(held) - sum(r == row for r, _ in cells)
        assert sum(r["row"] == row for r in got) == min(per_row, free)


def test_k_core_that_still_shrinks_is_an_error(spark):
    chain = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in (i, i + 1)], "row long, col long, value double")
    assert R.k_core(chain, 2, lambda df: df).count() == 0
    with pytest.raises(RuntimeError):
        R.k_core(chain, 2, lambda df: df, rounds=1)


def test_asked_columns_alone(spark):
    rnd = random.Random(9)
    cells = {(rnd.randrange(20), rnd.randrange(15)): rnd.choice([1, 2, 3]) for _ in range(120)}
    x = matrix(spark, cells)
    whole = {tuple(r) for r in R.similarity(x, "cosine", k=4).collect() if r["j"] in (3, 7)}
    assert {tuple(r) for r in R.similarity(x, "cosine", k=4, asked=spark.createDataFrame([(3,), (7,)], "col long")).collect()} == whole


def test_dense_knn_equals_all_pairs(spark):
    """Small blocks, copies (ties), a zero vector, none at all, ids twice; the shuffle holds k rows a block and row asked for, not a row a component and pair."""
    from pyspark.sql import functions as F

    rnd = np.random.default_rng(5)
    v = {i: [float(x) for x in rnd.normal(size=6)] for i in range(90)}
    v |= {i: v[i % 7] for i in range(60, 75)} | {80: [0.0] * 6, 81: None}
    rows = [*v.items(), (30, v[31])]
    size = lambda x: np.sqrt(sum(t * t for t in x))
    want = []
    for j in range(0, 90, 10):
        cell = lambda a, b: None if a is None or b is None else sum(s * t for s, t in zip(a, b, strict=True)) / (size(a) * size(b) + 1e-6)
        near = [(cell(a, b), i) for i, a in rows for h, b in rows if h == j and i != j]
        want += [(i, j, None if x is None else round(float(x), 6)) for x, i in sorted(near, key=lambda y: (y[0] is None, -(y[0] or 0), y[1]))[:4]]
    df = spark.createDataFrame(rows, "article long, vector array<double>").repartition(3)
    got = R.dense_knn(df, F.col("article") % 10 == 0, 4, block=8 * 6 * 7)
    assert sorted(map(repr, want)) == sorted(repr((r["i"], r["j"], None if r["value"] is None else round(r["value"], 6))) for r in got.collect())
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
