"""Sinks write what the sources read."""

import os

from pyspark.sql import functions as F

from tidemark.sources import sinks
from tidemark.sources.tables import table
from tidemark.streaming.windows import drained, hourly_counts, sessions

DATA = "/root/testdata/sf0.001"


def test_slices(spark, tmp_path):
    n = table(spark, DATA, "nation")
    paths = []
    for i in range(3):
        n.where(f"n_nationkey % 3 = {i}").write.parquet(paths.append(f"{tmp_path}/s{i}") or paths[-1])
    sinks.stack_slices(spark, paths, f"{tmp_path}/all", 1)
    back = spark.read.parquet(f"{tmp_path}/all")
    assert back.exceptAll(n).isEmpty() and n.exceptAll(back).isEmpty()


def test_csv(spark, tmp_path):
    r = table(spark, DATA, "region")
    r.write.option("header", True).option("sep", ";").csv(f"{tmp_path}/c")
    assert sorted(sinks.read_csv(spark, f"{tmp_path}/c", "r_regionkey int, r_name string", ";").collect()) == sorted(r.collect())


def test_coo(spark, tmp_path):
    m = spark.createDataFrame([(1, 2, 0.5), (0, 1, 1.0)], "row long, col long, value double")
    sinks.write_coo(m, f"{tmp_path}/m")
    assert sorted(spark.read.parquet(f"{tmp_path}/m").collect()) == sorted(m.collect())


def test_graph_headers(spark, tmp_path):
    nodes = spark.createDataFrame([("a",)], "id string")
    edges = spark.createDataFrame([("a", "a", "CLICK")], "src string, dst string, type string")
    sinks.write_graph(nodes, edges, f"{tmp_path}/g", "User")
    assert spark.read.option("header", True).csv(f"{tmp_path}/g/edges").columns == [":START_ID", ":END_ID", ":TYPE"]


def test_submission_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.9), (2, 10, 0.5)], "id long, item long, s double")
    lines = sinks.submission_lines(rows, "id", "s", ["item"], ["item"])
    sinks.write_submission(lines, f"{tmp_path}/sub")
    back = spark.read.text(f"{tmp_path}/sub").withColumnRenamed("value", "line")
    assert sorted(r["line"] for r in back.collect()) == ["1 [2,1]", "2 [1]"]
    assert sorted(map(tuple, sinks.parse_submission(back).collect())) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]


def test_streamed_sessions_equal_batch(spark, tmp_path):
    e = table(spark, DATA, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = sessions(stream, "ts", ["user_id"], "30 minutes", late="40 days").writeStream.outputMode("complete").format("memory").queryName("sess").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).count()
    assert spark.table("sess").agg(F.sum("n"), F.count("*")).first() == batch.agg(F.sum("count"), F.count("*")).first()


def test_late_rows_are_dropped_and_open_windows_wait(spark, tmp_path):
    def batch(i, *times):
        spark.createDataFrame([("click", f"2024-01-01 {t}") for t in times], "event_type string, t string").selectExpr("event_type", "cast(t as timestamp) ts").coalesce(1).write.parquet(f"{tmp_path}/{i}")
        (file,) = [f for f in os.listdir(f"{tmp_path}/{i}") if f.endswith(".parquet")]
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/{i}/{file}", f"{tmp_path}/in/{i}.parquet")
        os.utime(f"{tmp_path}/in/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))

    batch(1, "10:05:00", "10:50:00", "13:10:00")  # the watermark goes to 12:10
    batch(2, "12:30:00", "15:00:00")  # to 14:00
    batch(3, "10:20:00", "16:30:00")  # late by the watermark of the batch before the last
    stream = spark.readStream.schema("event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {(str(r["started"])[11:16], r["n"]) for r in drained(hourly_counts(stream), "late").collect()}
    assert got == {("10:00", 2), ("12:00", 1), ("13:00", 1)}
