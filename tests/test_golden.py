"""Small worked examples of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import lists as L
from tidemark.operators import metrics as M
from tidemark.operators import recommenders as R
from tidemark.operators import sampling as S
from tidemark.operators import windows as N
from tidemark.operators.asof import asof_join


def one(df):
    return [r[0] for r in df.collect()]


def test_labels(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([4, 5, 6], [3, 5]), ([7, 8], None)], "a array<int>, b array<int>")
    assert one(df.select(L.labels("a", "b"))) == [[0, 1, 1], [0, 1, 0], [0, 0]]


def test_share_matching(spark):
    df = spark.createDataFrame([([1, 2, 2], 2), ([3], 4)], "a array<int>, v int")
    assert [round(x, 6) for x in one(df.select(L.share_matching("a", F.col("v"))))] == [0.666667, 0.0]


def test_list_edges(spark):
    df = spark.createDataFrame([([1, None, 2],), ([],), (None,)], "a array<int>")
    assert one(df.select(L.contains("a", 9))) == [False, False, False]
    assert one(df.select(L.tail("a", 2))) == [[None, 2], [], None]
    assert one(df.select(L.pad_left("a", 4, 0))) == [[0, 1, None, 2], [0, 0, 0, 0], None]
    assert one(df.select(L.keep_in("a", [9]))) == [None, None, None]
    assert one(df.select(L.total("a"))) == [3.0, 0.0, None]
    assert one(df.select(L.mean("a"))) == [1.5, None, None]


def test_metric_examples(spark):
    truth = [[1, 0, 0, 1, 1], [0, 1, 0], [1, 0]]
    guess = [[0.9, 0.1, 0.8, 0.7, 0.2], [0.3, 0.2, 0.1], [0.4, 0.4]]
    rows = [(g, i, y, p) for g, (t, q) in enumerate(zip(truth, guess, strict=True)) for i, (y, p) in enumerate(zip(t, q, strict=True))]
    df = spark.createDataFrame(rows, "g int, i int, y int, p double")
    found = {r["g"]: r["auc"] for r in M.auc(df, ["g"], "p", "y").collect()}
    # Pairs of a positive above a negative, ties half.
    expected = {}
    for g, (t, q) in enumerate(zip(truth, guess, strict=True)):
        pairs = [(a, b) for a, y in zip(q, t, strict=True) if y for b, z in zip(q, t, strict=True) if not z]
        expected[g] = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    assert found == pytest.approx(expected)
    equal = df.withColumn("w", F.lit(1.0))
    assert {r["g"]: r["auc"] for r in M.weighted_auc(equal, ["g"], "p", "y", "w").collect()} == pytest.approx(expected)


def test_top_k_metrics(spark):
    truth = [2, 4, 5, 10]
    lists = {1: [1, 2, 3, 4, 5], 2: [10, 5, 2, 4, 3], 3: [1, 3, 6, 7, 8]}
    got = spark.createDataFrame([(u, x, i + 1) for u, items in lists.items() for i, x in enumerate(items)], "user long, item long, rank int")
    relevant = spark.createDataFrame([(u, x) for u in lists for x in truth], "user long, item long")
    r = {x["user"]: x for x in M.top_k_metrics(got, relevant, 5).collect()}
    assert [r[u]["recall"] for u in (1, 2, 3)] == [0.75, 1.0, 0.0]
    assert [r[u]["precision"] for u in (1, 2, 3)] == pytest.approx([0.6, 0.8, 0.0])
    assert [r[u]["rr"] for u in (1, 2, 3)] == [0.5, 1.0, 0.0]
    assert [r[u]["ap"] for u in (1, 2, 3)] == pytest.approx([(1 / 2 + 2 / 4 + 3 / 5) / 4, 1.0, 0.0])
    assert r[2]["ndcg"] == pytest.approx(1.0)


def test_metrics_without_recommendations(spark):
    got = spark.createDataFrame([], "user long, item long, rank int")
    relevant = spark.createDataFrame([(1, 2)], "user long, item long")
    assert tuple(M.top_k_metrics(got, relevant, 5).first()) == (1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0)


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_dense_index(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 1009).alias("k"), "id")
    rows = S.dense_index(df, ["k", "id"], "i").collect()
    assert [r["i"] for r in sorted(rows, key=lambda r: (r["k"], r["id"]))] == list(range(n))


def test_negative_sampling(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [1, 2]), (1, [1, 2, 3, 4], [1, 3]), (2, [1, 2, 3], [1]), (3, [1], [1])], "impression_id long, inview array<int>, clicked array<int>")
    rows = S.negative_samples(df, 1, seed=1).collect()
    assert len(rows) == 6
    for r in rows:
        assert r["items"][-1] == r["taken"]
        assert (r["items"][0] is None) == (r["impression_id"] == 3)


def test_sampling_repeats(spark):
    df = spark.createDataFrame([(i, list(range(10))) for i in range(20)], "k long, a array<int>")
    draw = lambda: one(df.select(S.sample_without(F.col("a"), 4, F.col("k"), 3)))
    first = draw()
    assert first == draw()
    assert all(len(set(x)) == 4 for x in first)


T = dt.datetime(2024, 1, 1)


def at(minutes):
    return T + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("direction,expected", [("backward", ["a", "a", "b", None]), ("forward", ["a", "b", None, None]), ("nearest", ["a", "a", "b", None])])
def test_asof(spark, direction, expected):
    left = spark.createDataFrame([(1, at(0)), (1, at(5)), (1, at(20)), (2, at(1))], "k int, t timestamp_ntz")
    right = spark.createDataFrame([(1, at(0), "a"), (1, at(10), "b")], "k int, t timestamp_ntz, v string")
    rows = asof_join(left, right, "t", ["k"], ["v"], direction).orderBy("k", "t").collect()
    assert [r["v"] for r in rows] == expected


def test_asof_null_value_is_a_match(spark):
    left = spark.createDataFrame([(1, at(5))], "k int, t timestamp_ntz")
    right = spark.createDataFrame([(1, at(0), "a"), (1, at(3), None)], "k int, t timestamp_ntz, v string")
    assert asof_join(left, right, "t", ["k"], ["v"]).first()["v"] is None


def test_ranks_and_norms(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", None), ("b", 0.0)], "g string, x double")
    assert sorted(one(df.select(N.rank_min("x", "g"))), key=str) == [1, 1, 1, None]
    assert one(df.where("g = 'b'").select(N.norm_sum("x", "g"))) == [None]


def test_similarity_by_hand(spark):
    # Columns (1, 1, 0), (1, 0, 1): one shared row.
    x = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (0, 1, 1.0), (2, 1, 1.0)], "row long, col long, value double")
    s = lambda kind, **k: {(r["i"], r["j"]): r["value"] for r in R.similarity(x, kind, **k).collect()}
    assert s("cosine")[0, 1] == pytest.approx(0.5, abs=1e-5)
    assert s("jaccard")[1, 0] == pytest.approx(1 / 3, abs=1e-5)
    assert s("dice")[0, 1] == pytest.approx(0.5, abs=1e-5)
    assert s("tversky", a=1.0, b=1.0)[0, 1] == pytest.approx(1 / 3, abs=1e-5)
    with pytest.raises(ValueError):
        R.similarity(x, "other")


def test_easer_refuses_dense(spark, monkeypatch):
    monkeypatch.setattr(R, "DENSE_LIMIT", 1)
    x = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "row long, col long, value double")
    with pytest.raises(ValueError):
        R.easer(spark, x, 1.0, 5)


def test_global_rolling_mean(spark):
    rows = [(i, at(m), float(i)) for i, m in enumerate([0, 10, 59, 60, 61, 119, 121, 300])]
    df = spark.createDataFrame(rows, "i int, ts timestamp_ntz, value double")
    got = {r["i"]: r["m"] for r in N.global_rolling_mean(df, "ts", "value", 3600, "m").collect()}
    for i, t, _ in rows:
        inside = [v for _, u, v in rows if t - dt.timedelta(hours=1) <= u <= t]
        assert got[i] == pytest.approx(sum(inside) / len(inside))


def test_dispersion_beyond_longs(spark):
    """A million items with 5,000 counts each: k N^2 is 2.5e25."""
    df = spark.range(1_000_000).select(F.when(F.col("id") == 0, 0).otherwise(5000).cast("long").alias("n"))
    k, total, square = 1_000_000, 5000 * 999_999, 5000**2 * 999_999
    assert one(M.dispersion(df)) == [pytest.approx(k * (total**2 - square) / (total**2 * (k - 1)), rel=1e-12)]
