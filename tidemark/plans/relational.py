"""Joins (J), aggregations (A), sorting and sampling (O), set operations (U)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lists as L
from ..functions import times as T
from ..operators import sampling as S
from ..operators import statistics as G
from ..operators.asof import asof_join
from ..sources.tables import candidates, clicks, ctes, impressions, items, table
from .base import register as q

R6 = lambda c: F.round(c, 6)
CAND = ["impression_id", "article", "seller"]


@q("j01_left_join", ctes("cand", "items") + " SELECT impression_id, article, seller, category, kind FROM cand LEFT JOIN items USING (article)")
def j01(spark, d):
    return candidates(spark, d).join(items(spark, d), "article", "left").select(*CAND, "category", "kind")


@q("j02_inner_join", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j02(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@q("j03_multi_key_join", ctes("cand") + ", s AS (SELECT impression_id, article, count(*) AS n FROM cand GROUP BY ALL) SELECT cand.impression_id, cand.article, seller, n FROM cand JOIN s ON s.impression_id = cand.impression_id AND s.article = cand.article")
def j03(spark, d):
    c = candidates(spark, d)
    n = c.groupBy("impression_id", "article").agg(F.count("*").alias("n"))
    return c.join(n, ["impression_id", "article"]).select(*CAND, "n")


@q("j04_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j04(spark, d):
    urgent = table(spark, d, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer", "c_custkey").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@q("j05_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def j05(spark, d):
    buyers = table(spark, d, "events", "user_id", "event_type").where("event_type = 'purchase'")
    return table(spark, d, "orders", "o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("user_id"), "left_semi").select("o_orderkey")


@q("j06_not_in", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def j06(spark, d):
    gone = table(spark, d, "events", "user_id", "event_type").where("event_type = 'error' and user_id is not null")
    return table(spark, d, "orders", "o_orderkey", "o_custkey").join(gone, F.col("o_custkey") == F.col("user_id"), "left_anti").select("o_orderkey")


_VIEWS = "v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL), b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')"


def _sides(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))


@q("j07_asof_nearest", f"WITH {_VIEWS}, p AS (SELECT event_id, b.user_id, b.ts, value, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(b.ts) - epoch_us(v.ts)), v.ts) AS rn FROM b LEFT JOIN v ON b.user_id = v.user_id) SELECT event_id, user_id, ts, round(value, 6) AS value FROM p WHERE rn = 1")
def j07(spark, d):
    left, right = _sides(spark, d)
    return asof_join(left, right, "ts", ["user_id"], ["value"], "nearest").withColumn("value", R6("value"))


@q("j08_asof_nearest_by_date", "WITH t AS (SELECT date_trunc('day', ts) AS ts, count(*) AS n FROM events WHERE event_type = 'signup' AND day(ts) % 3 = 0 GROUP BY 1), b AS (SELECT DISTINCT date_trunc('day', ts) AS ts FROM events), p AS (SELECT b.ts, n, row_number() OVER (PARTITION BY b.ts ORDER BY abs(epoch_us(b.ts) - epoch_us(t.ts)), t.ts) AS rn FROM b CROSS JOIN t) SELECT ts, n FROM p WHERE rn = 1")
def j08(spark, d):
    e = table(spark, d, "events", "ts", "event_type").withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    right = e.where("event_type = 'signup' and day(ts) % 3 = 0").groupBy("ts").agg(F.count("*").alias("n"))
    return asof_join(e.select("ts").distinct(), right, "ts", [], ["n"], "nearest")


@q("j09_asof_backward", f"WITH {_VIEWS} SELECT event_id, b.user_id, b.ts, round(value, 6) AS value FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts >= v.ts")
def j09(spark, d):
    left, right = _sides(spark, d)
    return asof_join(left, right, "ts", ["user_id"], ["value"]).withColumn("value", R6("value"))


@q("j09_asof_forward", f"WITH {_VIEWS} SELECT event_id, b.user_id, b.ts, round(value, 6) AS value FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts <= v.ts")
def j09f(spark, d):
    left, right = _sides(spark, d)
    return asof_join(left, right, "ts", ["user_id"], ["value"], "forward").withColumn("value", R6("value"))


@q("j10_computed_key_join", "WITH n AS (SELECT (ts::DATE + 1)::DATE AS day, count(*) AS n FROM events GROUP BY 1) SELECT event_id, coalesce(n, 0) AS yesterday FROM events LEFT JOIN n ON ts::DATE = day")
def j10(spark, d):
    e = table(spark, d, "events", "event_id", "ts")
    n = e.groupBy(F.date_add(F.to_date("ts"), 1).alias("day")).agg(F.count("*").alias("n"))
    return e.join(n, F.to_date("ts") == F.col("day"), "left").select("event_id", F.coalesce("n", F.lit(0)).alias("yesterday"))


@q("j12_self_join_paths", "SELECT a.event_id AS event_id, b.event_id AS next_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR")
def j12(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    # Buckets of the window's width make the range join an equi join: a partner lies in the same bucket or the next.
    width = 7200
    bucket = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / width)
    a = e.where("event_type = 'view'").select("user_id", "event_id", "ts", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    b = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("next_id"), F.col("ts").alias("next"), bucket.alias("bucket"))
    return a.join(b, ["user_id", "bucket"]).where("next > ts and next <= ts + INTERVAL 2 HOURS").select("event_id", "next_id")


@q("j13_map_list_values", ctes("imp") + ", m AS (SELECT p_partkey, p_size FROM part WHERE p_size > 10), x AS (SELECT impression_id, unnest(inview) AS a, generate_subscripts(inview, 1) AS pos FROM imp) SELECT impression_id, '[' || coalesce(string_agg(coalesce(p_size, 0)::VARCHAR, ',' ORDER BY pos), '') || ']' AS sizes, coalesce('[' || string_agg(p_size::VARCHAR, ',' ORDER BY pos) || ']', '[]') AS known FROM x LEFT JOIN m ON a = p_partkey GROUP BY impression_id")
def j13(spark, d):
    m = table(spark, d, "part", "p_partkey", "p_size").where("p_size > 10")
    x = impressions(spark, d).select("impression_id", F.posexplode("inview").alias("pos", "a")).join(m, F.col("a") == F.col("p_partkey"), "left")
    rows = x.groupBy("impression_id").agg(F.array_sort(F.collect_list(F.struct("pos", "p_size"))).alias("s"))
    return rows.select("impression_id", L.text(F.transform("s", lambda v: F.coalesce(v.p_size, F.lit(0)))).alias("sizes"), L.text(F.array_compact("s.p_size")).alias("known"))


@q("j16_matrix_product", ctes("clicks") + ", u AS (SELECT DISTINCT user_id, article FROM clicks), w AS (SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS w FROM lineitem GROUP BY ALL) SELECT user_id, j, round(sum(w), 6) AS score FROM u JOIN w ON article = i GROUP BY ALL")
def j16(spark, d):
    from ..operators.sparse import multiply

    u = clicks(spark, d).select(F.col("user_id").alias("row"), F.col("article").alias("col")).distinct().withColumn("value", F.lit(1.0))
    w = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity").groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_quantity").alias("value"))
    return multiply(u, w).select(F.col("row").alias("user_id"), F.col("col").alias("j"), R6("value").alias("score"))


@q("j17_interval_join", "SELECT event_id, o_orderkey FROM events JOIN orders ON user_id = o_custkey AND o_totalprice BETWEEN value * 1000 AND value * 1000 + 20000")
def j17(spark, d):
    e, o = table(spark, d, "events", "event_id", "user_id", "value"), table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return e.join(o, (F.col("user_id") == F.col("o_custkey")) & F.col("o_totalprice").between(F.col("value") * 1000, F.col("value") * 1000 + 20000)).select("event_id", "o_orderkey")


@q("a01_group_aggregates", "SELECT l_suppkey, sum(l_quantity) AS s, round(avg(l_quantity), 6) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi, median(l_quantity) AS med, round(stddev_samp(l_quantity), 6) AS sd, count(*) AS n, count(DISTINCT l_partkey) AS k FROM lineitem GROUP BY 1")
def a01(spark, d):
    x = "l_quantity"
    return table(spark, d, "lineitem", "l_suppkey", "l_partkey", x).groupBy("l_suppkey").agg(F.sum(x).alias("s"), R6(F.avg(x)).alias("m"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.median(x).alias("med"), R6(F.stddev_samp(x)).alias("sd"), F.count("*").alias("n"), F.count_distinct("l_partkey").alias("k"))


@q("a02_two_phase_ratio", "SELECT user_id, round(sum(value) FILTER (WHERE event_type = 'purchase') / sum(value), 6) AS share FROM events GROUP BY 1")
def a02(spark, d):
    e = table(spark, d, "events", "user_id", "value", "event_type")
    return e.groupBy("user_id").agg(R6(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))) / F.sum("value")).alias("share"))


@q("a03_collect_ordered", "SELECT user_id, '[' || string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) || ']' AS events FROM events GROUP BY 1")
def a03(spark, d):
    e = table(spark, d, "events", "user_id", "ts", "event_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("s"))
    return e.select("user_id", L.text("s.event_id").alias("events"))


@q("a04_flatten", ctes("imp") + ", x AS (SELECT user_id, unnest(clicked) AS a FROM imp) SELECT user_id, '[' || string_agg(a::VARCHAR, ',' ORDER BY a) || ']' AS taken FROM x GROUP BY 1")
def a04(spark, d):
    i = impressions(spark, d).groupBy("user_id").agg(F.array_sort(F.flatten(F.collect_list("clicked"))).alias("a"))
    return i.where(F.size("a") > 0).select("user_id", L.text("a").alias("taken"))


@q("a05_mode", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type AS favourite FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c) WHERE rn = 1")
def a05(spark, d):
    return G.mode_of(table(spark, d, "events", "user_id", "event_type"), ["user_id"], "event_type", "favourite")


@q("a06_first_of_functional", "SELECT o_custkey, any_value(c_name) AS name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def a06(spark, d):
    n = table(spark, d, "orders", "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.join(table(spark, d, "customer", "c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", F.col("c_name").alias("name"), "n")


@q("a07_count_entropy", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS t FROM c GROUP BY 1) SELECT user_id, round(abs(sum(-(n / t) * ln(n / t))), 6) AS entropy FROM c JOIN t USING (user_id) GROUP BY 1")
def a07(spark, d):
    e = G.entropy(table(spark, d, "events", "user_id", "event_type"), ["user_id"], "event_type", "entropy")
    return e.select("user_id", R6(F.abs("entropy")).alias("entropy"))


@q("a08_weight_entropy", "WITH t AS (SELECT l_suppkey, sum(l_quantity) AS t FROM lineitem GROUP BY 1) SELECT l_suppkey, round(-sum(l_quantity / t * ln(l_quantity / t)), 6) AS entropy FROM lineitem JOIN t USING (l_suppkey) GROUP BY 1")
def a08(spark, d):
    return table(spark, d, "lineitem", "l_suppkey", "l_quantity").groupBy("l_suppkey").agg(R6(G.weight_entropy("l_quantity")).alias("entropy"))


@q("a09_product", "SELECT l_orderkey, round(product(1 + l_tax), 6) AS factor FROM lineitem GROUP BY 1")
def a09(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_tax").groupBy("l_orderkey").agg(R6(F.exp(F.sum(F.ln(1 + F.col("l_tax"))))).alias("factor"))


@q("a10_distinct_first", "SELECT l_orderkey, l_partkey, min(l_suppkey) AS first_seller FROM lineitem GROUP BY ALL")
def a10(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey").groupBy("l_orderkey", "l_partkey").agg(F.min("l_suppkey").alias("first_seller"))


@q("a11_count_distinct", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, count(DISTINCT ts::DATE) AS days FROM events")
def a11(spark, d):
    e = table(spark, d, "events", "user_id", "event_type", "ts").select("user_id", "event_type", F.to_date("ts").alias("day"))
    return e.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"), F.count_distinct("day").alias("days"))


@q("a12_quantiles", "SELECT round(quantile_cont(value, 0.95), 6) AS cont, round(quantile_disc(value, 0.95), 6) AS disc FROM events")
def a12(spark, d):
    return table(spark, d, "events", "value").agg(R6(F.percentile("value", 0.95)).alias("cont"), R6(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)")).alias("disc"))


@q("a13_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS qp, round(corr(l_quantity, l_discount), 6) AS qd, round(corr(l_extendedprice, l_tax), 6) AS pt FROM lineitem")
def a13(spark, d):
    x = table(spark, d, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return x.agg(*(R6(F.corr(a, b)).alias(n) for a, b, n in (("l_quantity", "l_extendedprice", "qp"), ("l_quantity", "l_discount", "qd"), ("l_extendedprice", "l_tax", "pt"))))


@q("a14_pivot", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def a14(spark, d):
    p = table(spark, d, "events", "user_id", "event_type").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).count()
    return p.na.fill(0)


@q("a15_unpivot", "SELECT s_suppkey, 'balance' AS name, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier")
def a15(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot(["s_suppkey"], ["balance", "nation"], "name", "value")


@q("a16_transpose_audit", "SELECT 'c_name' AS name, count(*) - count(c_name) AS nulls FROM customer UNION ALL SELECT 'c_acctbal', count(*) - count(c_acctbal) FROM customer")
def a16(spark, d):
    c = table(spark, d, "customer", "c_name", "c_acctbal")
    return c.agg(*(F.count_if(F.col(x).isNull()).alias(x) for x in c.columns)).unpivot([], c.columns, "name", "nulls")


@q("a17_heat_map", "SELECT isodow(ts)::INTEGER AS weekday, " + ", ".join(f"round(avg(value) FILTER (WHERE hour(ts) // 6 = {i}), 6) AS h{i}" for i in range(4)) + " FROM events GROUP BY 1")
def a17(spark, d):
    e = table(spark, d, "events", "ts", "value").select(T.iso_weekday("ts").alias("weekday"), F.floor(F.hour("ts") / 6).alias("h"), "value")
    p = e.groupBy("weekday").pivot("h", [0, 1, 2, 3]).agg(R6(F.avg("value")))
    return p.toDF("weekday", "h0", "h1", "h2", "h3")


@q("a18_time_range", "SELECT min(ts) AS low, max(ts) AS high FROM events")
def a18(spark, d):
    return table(spark, d, "events", "ts").agg(F.min("ts").alias("low"), F.max("ts").alias("high"))


@q("a19_length_histogram", ctes("imp") + " SELECT len(inview) AS n, count(*) AS impressions FROM imp GROUP BY 1")
def a19(spark, d):
    return impressions(spark, d).groupBy(F.size("inview").cast("long").alias("n")).agg(F.count("*").alias("impressions"))


@q("a20_daily_top", "WITH c AS (SELECT ts::DATE AS day, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT day, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, user_id) AS rn FROM c) WHERE rn <= 3")
def a20(spark, d):
    c = table(spark, d, "events", "ts", "user_id").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("n"))
    return c.withColumn("rn", F.row_number().over(W.partitionBy("day").orderBy(F.desc("n"), "user_id"))).where("rn <= 3").drop("rn")


@q("a21_describe", "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS low, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(max(value), 6) AS high FROM events")
def a21(spark, d):
    x = "value"
    return table(spark, d, "events", x).agg(F.count(x).alias("n"), R6(F.avg(x)).alias("mean"), R6(F.stddev_samp(x)).alias("std"), R6(F.min(x)).alias("low"), R6(F.percentile(x, 0.25)).alias("p25"), R6(F.percentile(x, 0.5)).alias("p50"), R6(F.max(x)).alias("high"))


@q("a22_ratio_table", ctes("cand") + " SELECT article, sum(target)::BIGINT AS taken, count(*) AS shown, round(sum(target)::DOUBLE / count(*), 6) AS ratio FROM cand GROUP BY 1 HAVING count(*) >= 25 AND sum(target) >= 5")
def a22(spark, d):
    c = candidates(spark, d).groupBy("article").agg(F.sum("target").alias("taken"), F.count("*").alias("shown"))
    return c.where("shown >= 25 and taken >= 5").withColumn("ratio", R6(F.col("taken") / F.col("shown")))


@q("a23_rollup_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a23(spark, d):
    return table(spark, d, "lineitem", "l_returnflag", "l_linestatus").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@q("o01_sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def o01(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@q("o02_slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def o02(spark, d):
    return table(spark, d, "orders", "o_orderkey").orderBy("o_orderkey").offset(100).limit(50)


@q("o03_stable_reorder", ctes("imp") + ", x AS (SELECT impression_id, unnest(inview) AS a, generate_subscripts(inview, 1) AS pos FROM imp) SELECT impression_id, '[' || string_agg(p_size::VARCHAR, ',' ORDER BY pos) || ']' AS sizes FROM x JOIN part ON a = p_partkey GROUP BY 1")
def o03(spark, d):
    x = impressions(spark, d).select("impression_id", F.posexplode("inview").alias("pos", "a")).join(table(spark, d, "part", "p_partkey", "p_size"), F.col("a") == F.col("p_partkey"))
    return x.groupBy("impression_id").agg(F.array_sort(F.collect_list(F.struct("pos", "p_size"))).alias("s")).select("impression_id", L.text("s.p_size").alias("sizes"))


@q("o04_top_k_per_column", "SELECT l_suppkey, l_partkey, q FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS rn FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)) WHERE rn <= 5")
def o04(spark, d):
    from ..operators.sparse import top_per

    x = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return top_per(x, "l_suppkey", "q", ["l_partkey"], 5)


@q("o05_recommend", ctes("clicks") + ", p AS (SELECT article, count(*) AS n FROM clicks GROUP BY 1), u AS (SELECT DISTINCT user_id FROM clicks), top AS (SELECT article, n FROM p ORDER BY n DESC, article LIMIT 100), r AS (SELECT user_id, article, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, article) AS rn FROM u CROSS JOIN top WHERE NOT EXISTS (SELECT 1 FROM clicks c WHERE c.user_id = u.user_id AND c.article = top.article)) SELECT user_id, '[' || string_agg(article::VARCHAR, ',' ORDER BY rn) || ']' AS items FROM r WHERE rn <= 10 GROUP BY 1")
def o05(spark, d):
    c = clicks(spark, d).select("user_id", "article")
    top = c.groupBy("article").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "article").limit(100)
    listed = top.agg(F.collect_list(F.struct("n", "article")).alias("top"))
    users = c.select("user_id").distinct()
    r = users.crossJoin(F.broadcast(listed)).select("user_id", F.inline("top")).join(c, ["user_id", "article"], "left_anti")
    r = r.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "article"))).where("rn <= 10")
    return r.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rn", "article"))).alias("s")).select("user_id", L.text("s.article").alias("items"))


@q("o06_ranks", ctes("cand") + " SELECT impression_id, article, seller, row_number() OVER (PARTITION BY impression_id ORDER BY price DESC, article, seller)::INTEGER AS rank FROM cand")
def o06(spark, d):
    return candidates(spark, d).select(*CAND, F.row_number().over(W.partitionBy("impression_id").orderBy(F.desc("price"), "article", "seller")).alias("rank"))


_TEXT = lambda x: f"'[' || array_to_string({x}, ',') || ']'"
_PICK = lambda a, key, i: f"{a}[1 + ('0x' || substr(md5(concat_ws(':', {key}, {i}, 7)), 1, 8))::BIGINT % greatest(len({a}), 1)]"
_SHUFFLED = ", s AS (SELECT impression_id, inview, clicked, (SELECT list(x ORDER BY md5(concat_ws(':', impression_id, i, x, 7)), i) FROM (SELECT unnest(inview) AS x, generate_subscripts(inview, 1) - 1 AS i)) AS drawn FROM imp)"


@q("o07_shuffle_list", ctes("imp") + _SHUFFLED + f" SELECT impression_id, {_TEXT('inview')} AS inview, {_TEXT('drawn')} AS shuffled FROM s")
def o07(spark, d):
    return impressions(spark, d).select("impression_id", L.text("inview").alias("inview"), L.text(S.shuffled(F.col("inview"), F.col("impression_id"), 7)).alias("shuffled"))


@q("o08_sample_list", ctes("imp") + _SHUFFLED + f" SELECT impression_id, {_TEXT('drawn[:2]')} AS two, CASE WHEN len(clicked) > 0 THEN {_TEXT('[' + ', '.join(_PICK('clicked', 'impression_id', i) for i in (1, 2, 3)) + ']')} END AS three FROM s")
def o08(spark, d):
    three = F.when(F.size("clicked") > 0, L.text(S.sample_with(F.col("clicked"), 3, F.col("impression_id"), 7)))
    return impressions(spark, d).select("impression_id", L.text(S.sample_without(F.col("inview"), 2, F.col("impression_id"), 7)).alias("two"), three.alias("three"))


_KEY9 = "concat_ws('/', impression_id, turn)"


@q("o09_negative_sampling", ctes("imp") + ", r AS (SELECT impression_id, list_filter(inview, lambda x: NOT list_contains(clicked, x)) AS rest, unnest(clicked) AS taken, generate_subscripts(clicked, 1) - 1 AS turn FROM imp) SELECT impression_id, turn::INTEGER AS turn, taken, " + ", ".join(f"{_PICK('rest', _KEY9, i)} AS n{i}" for i in (1, 2)) + " FROM r")
def o09(spark, d):
    return S.negative_samples(impressions(spark, d), 2, seed=7).select("impression_id", F.col("at").alias("turn"), "taken", *(F.col("items")[i - 1].alias(f"n{i}") for i in (1, 2)))


@q("o10_subsample_by_key", ctes("cand") + " SELECT impression_id, article, seller, target FROM cand WHERE (impression_id, article, seller) IN (SELECT (impression_id, article, seller) FROM cand WHERE article % 5 = 0 OR target = 1)")
def o10(spark, d):
    c = candidates(spark, d)
    keys = c.where("article % 5 = 0 or target = 1").select(*CAND).distinct()
    return c.join(keys, CAND).select(*CAND, "target")


@q("o11_row_chunks", "SELECT c_custkey, ntile(7) OVER (ORDER BY c_custkey)::INTEGER AS chunk FROM customer")
def o11(spark, d):
    return S.global_ntile(table(spark, d, "customer", "c_custkey"), 7, ["c_custkey"], "chunk")


@q("o12_stratified_half", "SELECT o_orderkey, o_orderpriority, percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat_ws(':', o_orderkey, 7)), o_orderkey) < 0.5 AS half FROM orders")
def o12(spark, d):
    o = S.ranked_share(table(spark, d, "orders", "o_orderkey", "o_orderpriority"), ["o_orderpriority"], ["o_orderkey"], 7, "half")
    return o.select("o_orderkey", "o_orderpriority", (2 * F.col("half_place") < F.greatest(F.col("half_rows") - 1, F.lit(1))).alias("half"))


@q("o13_confident_rows", ctes("cand") + ", r AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY price DESC, article, seller) AS rn, lead(price) OVER (PARTITION BY impression_id ORDER BY price DESC, article, seller) AS second FROM cand) SELECT impression_id, article, seller, 1 AS label FROM r WHERE rn = 1 AND price - second > 20000")
def o13(spark, d):
    w = W.partitionBy("impression_id").orderBy(F.desc("price"), "article", "seller")
    r = candidates(spark, d).withColumns({"rn": F.row_number().over(w), "second": F.lead("price").over(w)})
    return r.where("rn = 1 and price - second > 20000").select(*CAND, F.lit(1).alias("label"))


@q("o14_negative_ratio", ctes("cand") + " SELECT round(count(*) FILTER (WHERE target = 0)::DOUBLE / sum(target), 6) AS ratio FROM cand")
def o14(spark, d):
    return candidates(spark, d).agg(R6(F.count_if(F.col("target") == 0) / F.sum("target")).alias("ratio"))


@q("o15_repeat_rows", ctes("cand") + " SELECT impression_id, article, seller, generate_series AS copy FROM cand, generate_series(1, CASE WHEN target = 1 THEN 2 ELSE 1 END)")
def o15(spark, d):
    return candidates(spark, d).select(*CAND, F.explode(F.sequence(F.lit(1).cast("long"), F.col("target").cast("long") + 1)).alias("copy"))


@q("o16_random_zeros")
def o16(spark, d):
    from ..operators.sparse import random_zeros

    m = clicks(spark, d).select(F.col("user_id").alias("row"), F.col("article").alias("col")).distinct()
    return random_zeros(m, per_row=3, seed=7)


@q("u01_concat", "SELECT o_orderkey AS id FROM orders UNION ALL SELECT event_id FROM events")
def u01(spark, d):
    return table(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("id")).unionByName(table(spark, d, "events", "event_id").select(F.col("event_id").alias("id")))


@q("u02_relaxed_concat", "SELECT c_nationkey::DOUBLE AS x FROM customer UNION ALL SELECT s_acctbal FROM supplier")
def u02(spark, d):
    return table(spark, d, "customer", "c_nationkey").select(F.col("c_nationkey").alias("x")).union(table(spark, d, "supplier", "s_acctbal"))


@q("u03_diagonal_concat", "SELECT c_custkey AS id, c_acctbal AS balance, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def u03(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)


@q("u04_distinct_ids", ctes("imp") + " SELECT DISTINCT id FROM (SELECT unnest(inview) AS id FROM imp UNION ALL SELECT unnest(clicked) FROM imp UNION ALL SELECT user_id FROM imp) WHERE id IS NOT NULL")
def u04(spark, d):
    i = impressions(spark, d)
    return i.select(F.explode(F.concat("inview", "clicked", F.array("user_id"))).alias("id")).where("id is not null").distinct()


@q("u06_row_intersect", "SELECT DISTINCT c_nationkey AS n FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u06(spark, d):
    return table(spark, d, "customer", "c_nationkey").select(F.col("c_nationkey").alias("n")).intersect(table(spark, d, "supplier", "s_nationkey"))


@q("u06_row_except", "SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'")
def u06b(spark, d):
    e = table(spark, d, "events", "user_id", "event_type")
    return e.where("event_type = 'click'").select("user_id").subtract(e.where("event_type = 'purchase'").select("user_id"))


@q("u07_frame_equality", "WITH b AS (SELECT * FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT * FROM nation WHERE n_nationkey < 3) SELECT (SELECT count(*) FROM (SELECT * FROM nation EXCEPT ALL SELECT * FROM b)) AS missing, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM nation)) AS surplus")
def u07(spark, d):
    a = table(spark, d, "nation")
    b = a.where("n_regionkey <> 2").unionByName(a.where("n_nationkey < 3")).orderBy(F.desc("n_nationkey"))
    missing, surplus = a.exceptAll(b).agg(F.count("*").alias("missing")), b.exceptAll(a).agg(F.count("*").alias("surplus"))
    return missing.crossJoin(F.broadcast(surplus))
