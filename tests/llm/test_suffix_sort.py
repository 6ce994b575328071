"""The distributed suffix sort against sorting."""

import random

import pytest

from tidemark.llm.suffix_sort import suffix_ranks


@pytest.mark.parametrize("n,letters", [(130, 2), (131, 3), (132, 1)])
def test_ranks_equal_sorting(spark, n, letters):
    rnd = random.Random(n)
    s = [rnd.randint(1, letters) for _ in range(n)]
    order = sorted(range(n), key=lambda i: s[i:])
    got = {r["pos"]: r["rank"] for r in suffix_ranks(spark.createDataFrame(list(enumerate(s)), "pos long, s long"), small=60).collect()}
    assert got == {p: i + 1 for i, p in enumerate(order)}


def test_small_texts(spark):
    assert [tuple(r) for r in suffix_ranks(spark.createDataFrame([(0, 5)], "pos long, s long")).collect()] == [(0, 1)]
    assert suffix_ranks(spark.createDataFrame([], "pos long, s long")).count() == 0
