"""The versions of the feature set: how often their rows are moved, and rows that lack an order, an article or a name."""

import duckdb
import pytest
from test_queries import DATA, TABLES, rows_of

from tidemark import plans
from tidemark.plans import versions
from tidemark.sources import cuts


@pytest.mark.parametrize("version", ["115f", "127", "142", "147"])
def test_rows_are_moved_once_in_the_result(spark, version):
    """The rows to their users, and those users: two shuffles besides joins of small frames; 30 and more when each block was joined for itself."""
    plan = plans.QUERIES[f"q30_features_{version}"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("Exchange hashpartitioning") <= 2


@pytest.mark.parametrize("version", ["115f", "127", "147"])
def test_rows_stand_by_user_in_the_result(spark, version):
    """The result reads its rows in buckets by user and shuffles the users alone, so no shuffle of all rows is on disk beside it."""
    plan = plans.QUERIES[f"q30_features_{version}"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


@pytest.mark.parametrize("version", ["115f", "127", "147"])
def test_rounds_change_no_row(spark, monkeypatch, version):
    query = plans.QUERIES[f"q30_features_{version}"]
    want = rows_of(map(tuple, query(spark, DATA).collect()))
    monkeypatch.setattr(versions, "AT_ONCE", 1000)
    assert versions._rounds(spark, DATA) == versions.ROUNDS
    assert rows_of(map(tuple, query(spark, DATA).collect())) == want


def test_clustered_keeps_rows_without_key(spark):
    df = spark.range(100).selectExpr("if(id % 9 = 0, null, id % 7) AS u", "id")
    got = cuts.clustered(df, "u", 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))


def test_incomplete_rows_equal_sql(spark, tmp_path):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE TABLE {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    con.sql("DELETE FROM orders WHERE o_orderkey % 11 = 0")
    con.sql("DELETE FROM part WHERE p_partkey % 13 = 0")
    con.sql("UPDATE orders SET o_custkey = NULL WHERE o_orderkey % 17 = 0")
    con.sql("UPDATE part SET p_name = NULL WHERE p_partkey % 7 = 0")
    con.sql("UPDATE part SET p_name = p_name || ' ' || p_name WHERE p_partkey % 5 = 0")
    con.sql("UPDATE lineitem SET l_shipdate = NULL WHERE l_orderkey % 19 = 0")
    for t in TABLES:
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = plans.QUERIES["q30_features_147"](spark, str(tmp_path))
    columns = sorted(got.columns)
    want = con.sql(plans.ORACLE["q30_features_147"])
    at = [want.columns.index(c) for c in columns]
    assert rows_of(map(tuple, got.select(*columns).collect())) == rows_of(tuple(r[i] for i in at) for r in want.fetchall())
