"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tidemark import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    return repr(x)


def rows_of(rows):
    return sorted(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = duck.sql(plans.ORACLE[name])
    assert columns == sorted(expected.columns)
    kinds = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds
    at = [expected.columns.index(c) for c in columns]
    assert rows_of(map(tuple, df.select(*columns).collect())) == rows_of(tuple(r[i] for i in at) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0
