"""Domain features (Q), user functions (X) and models (M)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import times as T
from ..operators import features as B
from ..operators import metrics as M
from ..operators import models
from ..operators import windows as N
from ..operators.asof import asof_join
from ..operators.statistics import entropy, mode_of
from ..sources.tables import candidates, clicks, ctes, items, table
from .base import register as q

R6 = lambda c: F.round(c, 6)
CAND = ["impression_id", "article", "seller"]


@q("q01_article_preprocessing", ctes("items") + " SELECT article, CASE WHEN kind = 'PROMO' THEN 1 WHEN kind = 'ECONOMY' THEN -1 ELSE 0 END AS sentiment, len(topics) AS n_topics, coalesce(kind, 'default') AS kind, array_to_string(list_transform(topics, lambda x: replace(x, ' ', '_')), ',') AS topics, length(category) AS n_chars FROM items")
def q01(spark, d):
    i = items(spark, d)
    mood = F.when(F.col("kind") == "PROMO", 1).when(F.col("kind") == "ECONOMY", -1).otherwise(0)
    return i.select("article", mood.alias("sentiment"), F.size("topics").cast("long").alias("n_topics"), F.coalesce("kind", F.lit("default")).alias("kind"), F.array_join(F.transform("topics", lambda x: F.replace(x, F.lit(" "), F.lit("_"))), ",").alias("topics"), F.length("category").cast("long").alias("n_chars"))


_TFIDF = "tok AS (SELECT article, lower(unnest(topics)) AS token FROM items), tf AS (SELECT article, token, count(*) AS tf FROM tok WHERE length(token) >= 2 GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), wt AS (SELECT article, token, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM items)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (token)), ti AS (SELECT article, token, w / sqrt(sum(w * w) OVER (PARTITION BY article)) AS weight FROM wt)"


@q("q02_topic_tf_idf", ctes("items") + f", {_TFIDF} SELECT article, token, round(weight, 6) AS weight FROM ti")
def q02(spark, d):
    return B.topic_tf_idf(items(spark, d)).select("article", "token", R6("weight").alias("weight"))


@q("q03_user_history_features", ctes("clicks", "items") + ", e AS (SELECT user_id, c.article, kind, category, quantity, c.price, hour(ts) AS hr, isodow(ts) AS wd FROM clicks c JOIN items i ON c.article = i.article), k AS (SELECT user_id, category AS favourite FROM (SELECT user_id, category, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category) AS rn FROM e GROUP BY user_id, category) WHERE rn = 1) SELECT e.user_id, count(*) AS n, round(avg(quantity), 6) AS mean_quantity, round(stddev_samp(price), 6) AS std_price, median(quantity) AS median_quantity, round(count(*) FILTER (WHERE kind = 'PROMO')::DOUBLE / count(*), 6) AS promo_share, count(DISTINCT category) AS categories, any_value(favourite) AS favourite FROM e JOIN k ON k.user_id = e.user_id GROUP BY 1")
def q03(spark, d):
    e = clicks(spark, d).join(items(spark, d).select("article", "kind", "category"), "article")
    a = e.groupBy("user_id").agg(F.count("*").alias("n"), R6(F.avg("quantity")).alias("mean_quantity"), R6(F.stddev_samp("price")).alias("std_price"), F.median("quantity").alias("median_quantity"), R6(F.count_if(F.col("kind") == "PROMO") / F.count("*")).alias("promo_share"), F.count_distinct("category").alias("categories"))
    return a.join(mode_of(e, ["user_id"], "category", "favourite"), "user_id")


_PAIR = ", h AS (SELECT DISTINCT user_id, article AS seen FROM clicks), c AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS article FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _user_candidates(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    return candidates(spark, d).join(o, F.col("impression_id") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), "article").distinct()


@q("q04_history_join_features", ctes("clicks", "items") + _PAIR + ", j AS (SELECT c.user_id, c.article, len(list_intersect(a.topics, b.topics))::DOUBLE / len(list_distinct(list_concat(a.topics, b.topics))) AS j, len(list_intersect(a.topics, b.topics)) AS common FROM c JOIN h ON h.user_id = c.user_id JOIN items a ON a.article = c.article JOIN items b ON b.article = seen) SELECT user_id, article, round(avg(j), 6) AS mean_j, round(max(j), 6) AS max_j, round(min(j), 6) AS min_j, round(stddev_samp(j), 6) AS std_j, round(avg(common), 6) AS mean_common, max(common)::INTEGER AS max_common FROM j GROUP BY ALL")
def q04(spark, d):
    h = clicks(spark, d).select("user_id", F.col("article").alias("seen")).distinct()
    f = B.history_similarity(_user_candidates(spark, d), h, items(spark, d).select("article", "topics"))
    return f.select("user_id", "article", *(c if c == "max_common" else R6(c).alias(c) for c in f.columns[2:]))


_DEMAND = ", dem AS (SELECT DISTINCT article, shown::DATE AS day FROM cand)"


def _demand(spark, d):
    return candidates(spark, d).select("article", F.to_date("shown").alias("day")).distinct()


@q("q05_topic_trendiness", ctes("cand", "items") + _DEMAND + ", p AS (SELECT unnest(topics) AS topic, published::DATE AS day FROM items WHERE published IS NOT NULL), t AS (SELECT article, day, unnest(list_distinct(topics)) AS topic FROM dem JOIN items USING (article)), e AS (SELECT min(day) AS a, max(day) AS b FROM p), n AS (SELECT t.article, t.day, t.topic, CASE WHEN t.day - 1 BETWEEN a AND b THEN count(p.day) ELSE 0 END AS n FROM t CROSS JOIN e LEFT JOIN p ON p.topic = t.topic AND p.day >= t.day - 3 AND p.day <= t.day - 1 GROUP BY t.article, t.day, t.topic, a, b) SELECT article, day, sum(n)::BIGINT AS trend FROM n GROUP BY ALL")
def q05(spark, d):
    i = items(spark, d)
    published = i.where("published is not null").select(F.explode("topics").alias("topic"), F.to_date("published").alias("day"))
    demand = _demand(spark, d).join(i.select("article", F.array_distinct("topics").alias("t")), "article").select("article", "day", F.explode("t").alias("topic"))
    return B.trendiness(demand, published, 3, "topic").groupBy("article", "day").agg(F.sum("n").alias("trend"))


@q("q06_category_trendiness", ctes("cand", "items") + _DEMAND + ", p AS (SELECT category, published::DATE AS day FROM items WHERE published IS NOT NULL), e AS (SELECT min(day) AS a, max(day) AS b FROM p) SELECT dem.article, dem.day, CASE WHEN dem.day - 1 BETWEEN a AND b THEN count(p.day) ELSE 0 END AS trend FROM dem JOIN items ON items.article = dem.article CROSS JOIN e LEFT JOIN p ON p.category = items.category AND p.day >= dem.day - 5 AND p.day <= dem.day - 1 GROUP BY dem.article, dem.day, a, b")
def q06(spark, d):
    i = items(spark, d)
    published = i.where("published is not null").select("category", F.to_date("published").alias("day"))
    demand = _demand(spark, d).join(i.select("article", "category"), "article").select("article", "day", "category")
    return B.trendiness(demand, published, 5, "category").select("article", "day", F.col("n").alias("trend"))


@q("q07_trend_leak", "WITH c AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), t AS (SELECT day - 2 AS day, sum(n) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM c), b AS (SELECT DISTINCT ts::DATE AS day FROM events), p AS (SELECT b.day, t.n, row_number() OVER (PARTITION BY b.day ORDER BY abs(b.day - t.day), t.day) AS rn FROM b CROSS JOIN t) SELECT day, n::BIGINT AS ahead FROM p WHERE rn = 1")
def q07(spark, d):
    c = table(spark, d, "events", "ts").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    # One row a day: windows without a key are over the calendar, not the data.
    t = c.select(F.date_sub("day", 2).cast("timestamp_ntz").alias("day"), F.sum("n").over(W.orderBy("day").rowsBetween(-2, 0)).alias("ahead"))
    return asof_join(c.select(F.col("day").cast("timestamp_ntz").alias("day")), t, "day", [], ["ahead"], "nearest").withColumn("day", F.to_date("day"))


@q("q08_category_popularity_yesterday", "WITH p AS (SELECT p_brand AS category, (min(l_shipdate)::DATE + 1)::DATE AS day FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_brand), t AS (SELECT day, count(*) AS all_n FROM p GROUP BY 1), s AS (SELECT day, category, count(*) AS n FROM p GROUP BY ALL) SELECT x.impression_id, x.article, x.seller, round(coalesce(n::DOUBLE / all_n, 0), 6) AS share FROM (SELECT l_orderkey AS impression_id, l_partkey AS article, l_suppkey AS seller, l_shipdate::DATE AS day, p_brand AS category FROM lineitem JOIN part ON l_partkey = p_partkey) x LEFT JOIN t ON t.day = x.day LEFT JOIN s ON s.day = x.day AND s.category = x.category")
def q08(spark, d):
    i = items(spark, d)
    p = i.where("published is not null").select("category", F.date_add(F.to_date("published"), 1).alias("day"))
    s = p.groupBy("day", "category").agg(F.count("*").alias("n"))
    t = s.groupBy("day").agg(F.sum("n").alias("all_n"))
    x = candidates(spark, d).join(i.select("article", "category"), "article").withColumn("day", F.to_date("shown"))
    return x.join(s.join(t, "day"), ["day", "category"], "left").select(*CAND, R6(F.coalesce(F.col("n") / F.col("all_n"), F.lit(0.0))).alias("share"))


@q("q09_session_features", "WITH s AS (SELECT user_id, ts::DATE AS day, max(ts) AS last_ts, date_sub('minute', min(ts), max(ts)) AS minutes, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, day, lag(minutes) OVER w AS last_minutes, date_sub('hour', lag(last_ts) OVER w, last_ts) AS hours_since, round(avg(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS mean_n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day)")
def q09(spark, d):
    s = table(spark, d, "events", "user_id", "ts").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("ts").alias("last_ts"), F.min("ts").alias("first_ts"), F.count("*").alias("n"))
    w = W.partitionBy("user_id").orderBy("day")
    s = s.withColumn("minutes", T.between("MINUTE", "first_ts", "last_ts"))
    return s.select("user_id", "day", F.lag("minutes").over(w).alias("last_minutes"), T.between("HOUR", F.lag("last_ts").over(w), "last_ts").alias("hours_since"), R6(N.rolling_rows(F.avg, "n", ["user_id"], ["day"], 100)).alias("mean_n"))


_DELAY = ctes("clicks", "items") + ", t AS (SELECT user_id, unnest(topics) AS topic, date_sub('day', published, ts) AS age FROM clicks JOIN items USING (article)), m AS (SELECT topic, user_id, avg(age) AS age FROM t GROUP BY ALL)"


def _delays(spark, d):
    i = items(spark, d)
    x = clicks(spark, d).join(i.select("article", "topics", "published"), "article").select("user_id", F.explode("topics").alias("topic"), T.between("DAY", "published", "ts").alias("age"))
    return x.groupBy("topic", "user_id").agg(F.avg("age").alias("age"))


@q("q10_mean_delays", _DELAY + " SELECT topic, user_id, round(age, 6) AS age FROM m")
def q10(spark, d):
    return _delays(spark, d).withColumn("age", R6("age"))


@q("q11_add_mean_delays", _DELAY + ", c AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS article FROM orders JOIN lineitem ON o_orderkey = l_orderkey), e AS (SELECT user_id, article, unnest(topics) AS topic FROM c JOIN items USING (article)) SELECT e.user_id, e.article, round(avg(age), 6) AS age FROM e LEFT JOIN m ON m.topic = e.topic AND m.user_id = e.user_id GROUP BY ALL")
def q11(spark, d):
    e = _user_candidates(spark, d).join(items(spark, d).select("article", F.explode("topics").alias("topic")), "article")
    return e.join(_delays(spark, d), ["topic", "user_id"], "left").groupBy("user_id", "article").agg(R6(F.avg("age")).alias("age"))


_HT = ctes("clicks", "items") + ", p AS (SELECT topic, day, count(*) AS n FROM (SELECT unnest(topics) AS topic, published::DATE AS day FROM items WHERE published IS NOT NULL) GROUP BY ALL), ends AS (SELECT min(day) AS a, max(day) AS b FROM p), dem AS (SELECT DISTINCT article, ts::DATE AS day FROM clicks), t AS (SELECT article, day, unnest(list_distinct(topics)) AS topic FROM dem JOIN items USING (article)), n AS (SELECT t.article, t.day, CASE WHEN t.day - 1 BETWEEN a AND b THEN coalesce(sum(p.n), 0) ELSE 0 END AS n FROM t CROSS JOIN ends LEFT JOIN p ON p.topic = t.topic AND p.day >= t.day - 3 AND p.day <= t.day - 1 GROUP BY t.article, t.day, t.topic, a, b), tr AS (SELECT article, day, sum(n)::BIGINT AS trend FROM n GROUP BY ALL), h AS (SELECT user_id, c.article, trend FROM clicks c JOIN tr ON tr.article = c.article AND tr.day = c.ts::DATE), mu AS (SELECT user_id, avg(trend) AS mean FROM h GROUP BY 1), mt AS (SELECT topic, avg(trend) AS mean FROM (SELECT trend, unnest(topics) AS topic FROM h JOIN items USING (article)) GROUP BY 1)"


def _history_trend(spark, d):
    """(user_id, article, trend): what each article read had as its topic trendiness on the day it was read."""
    i = items(spark, d)
    h = clicks(spark, d).select("user_id", "article", F.to_date("ts").alias("day"))
    published = i.where("published is not null").select(F.explode("topics").alias("topic"), F.to_date("published").alias("day"))
    demand = h.select("article", "day").distinct().join(i.select("article", F.array_distinct("topics").alias("t")), "article").select("article", "day", F.explode("t").alias("topic"))
    return h.join(B.trendiness(demand, published, 3, "topic").groupBy("article", "day").agg(F.sum("n").alias("trend")), ["article", "day"])


def _topic_trend(spark, d):
    return _history_trend(spark, d).join(items(spark, d).select("article", "topics"), "article").select(F.explode("topics").alias("topic"), "trend").groupBy("topic").agg(F.avg("trend").alias("mean"))


@q("q12_history_trend_means", _HT + " SELECT user_id, round(mean, 6) AS mean FROM mu")
def q12(spark, d):
    return _history_trend(spark, d).groupBy("user_id").agg(R6(F.avg("trend")).alias("mean"))


@q("q12_topic_trend_means", _HT + " SELECT topic, round(mean, 6) AS mean FROM mt")
def q12b(spark, d):
    return _topic_trend(spark, d).withColumn("mean", R6("mean"))


@q("q13_add_history_trend", _HT + ", c AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS article FROM orders JOIN lineitem ON o_orderkey = l_orderkey), e AS (SELECT article, len(topics) AS k, unnest(list_distinct(topics)) AS topic FROM items), s AS (SELECT article, sum(coalesce(mean, 0)) / any_value(k) AS topics FROM e LEFT JOIN mt USING (topic) GROUP BY 1) SELECT c.user_id, c.article, round(mu.mean, 6) AS user_trend, round(topics, 6) AS topics_trend FROM c LEFT JOIN mu USING (user_id) LEFT JOIN s USING (article)")
def q13(spark, d):
    users = _history_trend(spark, d).groupBy("user_id").agg(R6(F.avg("trend")).alias("user_trend"))
    e = items(spark, d).select("article", F.size("topics").alias("k"), F.explode(F.array_distinct("topics")).alias("topic")).join(_topic_trend(spark, d), "topic", "left")
    # The topics' part is the article's alone.
    articles = e.groupBy("article").agg(R6(F.sum(F.coalesce("mean", F.lit(0.0))) / F.max("k")).alias("topics_trend"))
    return _user_candidates(spark, d).join(users, "user_id", "left").join(articles, "article", "left").select("user_id", "article", "user_trend", "topics_trend")


_PARTS = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in {"morning": "hour(ts) >= 5 AND hour(ts) < 13", "noon": "hour(ts) >= 12 AND hour(ts) < 19", "evening": "hour(ts) >= 18 AND hour(ts) < 23", "night": "hour(ts) >= 22 OR hour(ts) < 6"}.items())


@q("q14_window_histories", f"SELECT user_id, event_type, {_PARTS} FROM events GROUP BY ALL")
def q14(spark, d):
    e = table(spark, d, "events", "user_id", "event_type", "ts")
    return B.part_counts(e, ["user_id", "event_type"], {p: T.in_part("ts", p) for p in T.DAY_PARTS})


@q("q15_window_features", f"WITH p AS (SELECT user_id, event_type, {_PARTS} FROM events GROUP BY ALL) SELECT event_id, greatest(CASE WHEN hour(ts) >= 5 AND hour(ts) < 13 THEN morning ELSE 0 END, CASE WHEN hour(ts) >= 12 AND hour(ts) < 19 THEN noon ELSE 0 END, CASE WHEN hour(ts) >= 18 AND hour(ts) < 23 THEN evening ELSE 0 END, CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN night ELSE 0 END) AS score FROM events JOIN p USING (user_id, event_type)")
def q15(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    p = B.part_counts(e, ["user_id", "event_type"], {p: T.in_part("ts", p) for p in T.DAY_PARTS})
    return e.join(p, ["user_id", "event_type"]).select("event_id", F.greatest(*(F.when(T.in_part("ts", p), F.col(p)).otherwise(F.lit(0)) for p in T.DAY_PARTS)).alias("score"))


_END = "m AS (SELECT user_id, date_trunc('minute', ts + INTERVAL 30 SECOND) AS minute, count(*) AS n FROM events GROUP BY ALL), e AS (SELECT user_id, minute, sum(n) OVER (PARTITION BY user_id ORDER BY minute RANGE BETWEEN INTERVAL 599 MINUTE PRECEDING AND CURRENT ROW) AS x FROM m)"


def _endorsement(spark, d):
    m = table(spark, d, "events", "user_id", "ts").groupBy("user_id", T.nearest_minute("ts").alias("minute")).agg(F.count("*").alias("n"))
    return m.select("user_id", "minute", N.rolling_time(F.col("n"), ["user_id"], "minute", 36000).alias("x"))


@q("q16_q19_join_endorsement", f"WITH {_END} SELECT event_id, x::BIGINT AS endorsement FROM events JOIN e ON events.user_id = e.user_id AND minute = date_trunc('minute', ts + INTERVAL 30 SECOND)")
def q16(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts").withColumn("minute", T.nearest_minute("ts"))
    return e.join(_endorsement(spark, d), ["user_id", "minute"]).select("event_id", F.col("x").alias("endorsement"))


@q("q18_endorsement_normalised", f"WITH {_END} SELECT user_id, minute, round(x / sum(x) OVER (PARTITION BY minute), 6) AS share, round(x - avg(x) OVER (PARTITION BY user_id ORDER BY minute ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS diff, round(x / max(x) OVER (PARTITION BY user_id ORDER BY minute ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS ratio FROM e")
def q18(spark, d):
    by, order = ["user_id"], ["minute"]
    return _endorsement(spark, d).select("user_id", "minute", R6(N.norm_sum("x", "minute")).alias("share"), R6(F.col("x") - N.rolling_rows(F.avg, "x", by, order, 5)).alias("diff"), R6(F.col("x") / N.rolling_rows(F.max, "x", by, order, 10)).alias("ratio"))


@q("q20_endorsement_leak", f"WITH {_END}, b AS (SELECT event_id, user_id, ts + INTERVAL 10 HOUR AS at FROM events WHERE event_type = 'purchase'), p AS (SELECT event_id, x, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(b.\"at\") - epoch_us(minute)), minute) AS rn FROM b JOIN e ON e.user_id = b.user_id) SELECT event_id, x::BIGINT AS ahead FROM p WHERE rn = 1".replace(" AS at FROM", ' AS "at" FROM'))
def q20(spark, d):
    left = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").where("event_type = 'purchase'").select("event_id", "user_id", (F.col("ts") + F.expr("INTERVAL 10 HOURS")).alias("at"))
    right = _endorsement(spark, d).select("user_id", F.col("minute").alias("at"), F.col("x").alias("ahead"))
    return asof_join(left, right, "at", ["user_id"], ["ahead"], "nearest").select("event_id", "ahead")


_TOPICS = ("click", "view", "purchase")


@q("q21_topic_endorsement_matrix", "WITH h AS (SELECT event_type, date_trunc('hour', ts + INTERVAL 30 MINUTE) AS hr, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT event_type, hr, sum(n) OVER (PARTITION BY event_type ORDER BY hr RANGE BETWEEN INTERVAL 9 HOUR PRECEDING AND CURRENT ROW) AS x FROM h) SELECT hr, " + ", ".join(f"max(x) FILTER (WHERE event_type = '{t}')::BIGINT AS {t}" for t in _TOPICS) + " FROM r GROUP BY 1")
def q21(spark, d):
    h = table(spark, d, "events", "event_type", "ts").groupBy("event_type", T.nearest_hour("ts").alias("hr")).agg(F.count("*").alias("n"))
    r = h.select("event_type", "hr", N.rolling_time(F.col("n"), ["event_type"], "hr", 36000).alias("x"))
    return r.groupBy("hr").pivot("event_type", list(_TOPICS)).agg(F.max("x"))


@q("q22_click_inview_counts", ctes("cand") + " SELECT article, count(*) AS inviews, sum(target)::BIGINT AS clicks FROM cand GROUP BY 1")
def q22(spark, d):
    return candidates(spark, d).groupBy("article").agg(F.count("*").alias("inviews"), F.sum("target").alias("clicks"))


_POPR = "pr AS (SELECT article, sum(target)::DOUBLE / count(*) AS r FROM cand GROUP BY 1)"


def _ratio(spark, d):
    return candidates(spark, d).groupBy("article").agg((F.sum("target") / F.count("*")).alias("r"))


@q("q23_popularity_history", ctes("cand", "clicks") + f", {_POPR} SELECT user_id, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(median(r), 6) AS mid FROM clicks JOIN pr USING (article) GROUP BY 1")
def q23(spark, d):
    return clicks(spark, d).join(_ratio(spark, d), "article").groupBy("user_id").agg(R6(F.avg("r")).alias("mean"), R6(F.stddev_samp("r")).alias("std"), R6(F.median("r")).alias("mid"))


@q("q24_segment_block", ctes("cand") + ", s AS (SELECT c_mktsegment AS segment, article, avg(target) AS rate, count(*) AS n FROM cand JOIN orders ON impression_id = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT segment, article, round(rate, 6) AS rate, n, round(rate / nullif(max(rate) OVER (PARTITION BY segment), 0), 6) AS rate_norm FROM s")
def q24(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey").join(table(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    s = candidates(spark, d).join(o, F.col("impression_id") == F.col("o_orderkey")).groupBy(F.col("c_mktsegment").alias("segment"), "article").agg(F.avg("target").alias("rate"), F.count("*").alias("n"))
    return s.select("segment", "article", R6("rate").alias("rate"), "n", R6(N.norm_max("rate", "segment")).alias("rate_norm"))


@q("q26_last_n_topic_cosine", ctes("clicks", "items") + f", {_TFIDF}, l AS (SELECT user_id, article FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, impression_id DESC, article DESC, seller DESC) AS rn FROM clicks) WHERE rn <= 5), u AS (SELECT user_id, token, sum(weight) AS w FROM l JOIN ti USING (article) GROUP BY ALL), c AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS article FROM orders JOIN lineitem ON o_orderkey = l_orderkey), nu AS (SELECT user_id, sqrt(sum(w * w)) AS n FROM u GROUP BY 1), d AS (SELECT c.user_id, c.article, sum(u.w * ti.weight) AS dot FROM c JOIN u ON u.user_id = c.user_id JOIN ti ON ti.article = c.article AND ti.token = u.token GROUP BY ALL) SELECT c.user_id, c.article, round(coalesce(dot / nu.n, 0), 6) AS cosine FROM c LEFT JOIN d ON d.user_id = c.user_id AND d.article = c.article LEFT JOIN nu ON nu.user_id = c.user_id")
def q26(spark, d):
    tokens = B.topic_tf_idf(items(spark, d))
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("impression_id"), F.desc("article"), F.desc("seller"))
    last = clicks(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("user_id", "article")
    users = last.join(tokens, "article").groupBy("user_id", "token").agg(F.sum("weight").alias("weight"))
    return B.sparse_cosine(users, tokens, _user_candidates(spark, d), "user_id", "article").withColumn("cosine", R6("cosine"))


@q("q27_diversity_block", ctes("clicks", "items") + ", c AS (SELECT user_id, category, count(*) AS n FROM clicks JOIN items USING (article) GROUP BY ALL), t AS (SELECT user_id, sum(n) AS t FROM c GROUP BY 1) SELECT user_id, round(abs(-sum(n / t * ln(n / t))), 6) AS entropy FROM c JOIN t USING (user_id) GROUP BY 1")
def q27(spark, d):
    e = clicks(spark, d).join(items(spark, d).select("article", "category"), "article")
    return entropy(e, ["user_id"], "category", "entropy").select("user_id", R6(F.abs("entropy")).alias("entropy"))


@q("q28_q39_build_features", ctes("cand", "clicks", "items") + f", {_POPR}, u AS (SELECT user_id, count(*) AS reads, avg(quantity) AS mean_quantity FROM clicks GROUP BY 1) SELECT impression_id, o_custkey AS user_id, cand.article, seller, shown::DATE AS day, target, category, len(topics) AS n_topics, date_sub('day', published, shown) AS age, coalesce(reads, 0) AS reads, round(r, 6) AS popularity, round(cand.price / max(cand.price) OVER (PARTITION BY impression_id), 6) AS price_norm, rank() OVER (PARTITION BY impression_id ORDER BY r DESC)::INTEGER AS popularity_rank, round(cand.quantity - mean_quantity, 6) AS quantity_diff FROM cand JOIN orders ON impression_id = o_orderkey JOIN items ON items.article = cand.article JOIN pr ON pr.article = cand.article LEFT JOIN u ON u.user_id = o_custkey")
def q28(spark, d):
    c = candidates(spark, d)
    o = table(spark, d, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("impression_id"), F.col("o_custkey").alias("user_id"))
    u = clicks(spark, d).groupBy("user_id").agg(F.count("*").alias("reads"), F.avg("quantity").alias("mean_quantity"))
    x = c.join(o, "impression_id").join(items(spark, d).drop("price", "size", "kind"), "article").join(_ratio(spark, d), "article").join(u, "user_id", "left")
    x = N.normalise_all(x, {("impression_id",): {"price_norm": R6(N.norm_max("price", "impression_id")), "popularity_rank": N.rank_min("r", "impression_id", descending=True)}})
    return x.select(*CAND, "user_id", F.to_date("shown").alias("day"), "target", "category", F.size("topics").cast("long").alias("n_topics"), T.between("DAY", "published", "shown").alias("age"), F.coalesce("reads", F.lit(0)).alias("reads"), R6("r").alias("popularity"), "price_norm", "popularity_rank", R6(F.col("quantity") - F.col("mean_quantity")).alias("quantity_diff"))


@q("q31_topic_mixtures")
def q31(spark, d):
    return models.topic_mixtures(items(spark, d).select("article", "topics"), "article", "topics", 5)


@q("q31_hour_weighted_means", ctes("clicks") + ", w AS (SELECT user_id, quantity, 1.0 / (1 + date_sub('hour', ts, max(ts) OVER (PARTITION BY user_id))) AS w FROM clicks) SELECT user_id, round(sum(w * quantity) / sum(w), 6) AS mean FROM w GROUP BY 1")
def q31b(spark, d):
    w = 1.0 / (1 + T.between("HOUR", F.col("ts"), F.max("ts").over(W.partitionBy("user_id"))))
    return clicks(spark, d).withColumn("w", w).groupBy("user_id").agg(R6(F.sum(F.col("w") * F.col("quantity")) / F.sum("w")).alias("mean"))


@q("q32_target_encoding", ctes("cand") + ", t AS (SELECT avg(target) AS m, var_pop(target) AS v FROM cand), g AS (SELECT seller, count(*) AS n, avg(target) AS mk, var_pop(target) AS vk FROM cand GROUP BY 1) SELECT seller, round(coalesce(n * v / (n * v + vk), 0) * mk + (1 - coalesce(n * v / (n * v + vk), 0)) * m, 6) AS encoded FROM g, t")
def q32(spark, d):
    return B.target_encoding(candidates(spark, d), "seller", "target").withColumn("encoded", R6("encoded"))


@q("q33_stacking_features", ctes("cand") + ", n AS (SELECT *, (price - min(price) OVER i) / nullif(max(price) OVER i - min(price) OVER i, 0) AS a, (quantity - min(quantity) OVER i) / nullif(max(quantity) OVER i - min(quantity) OVER i, 0) AS b FROM cand WINDOW i AS (PARTITION BY impression_id)), m AS (SELECT *, 0.6 * a + 0.4 * b AS s FROM n) SELECT impression_id, article, seller, round(s, 6) AS score, round(s - avg(s) OVER (PARTITION BY impression_id), 6) AS diff, rank() OVER (PARTITION BY impression_id ORDER BY round(s, 9) DESC NULLS LAST)::INTEGER AS place FROM m WHERE s IS NOT NULL")
def q33(spark, d):
    a, b = N.min_max("price", "impression_id"), N.min_max("quantity", "impression_id")
    x = candidates(spark, d).withColumns({"a": a, "b": b}).withColumn("s", 0.6 * F.col("a") + 0.4 * F.col("b")).where("s is not null").withColumn("s9", F.round("s", 9))
    return x.select(*CAND, R6("s").alias("score"), R6(N.diff_mean("s", "impression_id")).alias("diff"), N.rank_min("s9", "impression_id", descending=True).alias("place"))


@q("q34_activity_features", ctes("clicks", "items") + ", c AS (SELECT user_id, category, count(*) AS n FROM clicks JOIN items USING (article) GROUP BY ALL) SELECT user_id, category, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share, (sum(n) OVER (PARTITION BY user_id))::BIGINT AS activity FROM c")
def q34(spark, d):
    c = clicks(spark, d).join(items(spark, d).select("article", "category"), "article").groupBy("user_id", "category").agg(F.count("*").alias("n"))
    return c.select("user_id", "category", "n", R6(N.norm_sum("n", "user_id")).alias("share"), F.sum("n").over(W.partitionBy("user_id")).alias("activity"))


@q("q35_click_predictor_norm", ctes("cand") + ", n AS (SELECT *, price / max(price) OVER i + quantity / max(quantity) OVER i AS s FROM cand WINDOW i AS (PARTITION BY impression_id)) SELECT impression_id, article, seller, round(s / max(s) OVER (PARTITION BY impression_id), 6) AS score FROM n")
def q35(spark, d):
    x = candidates(spark, d).withColumn("s", N.norm_max("price", "impression_id") + N.norm_max("quantity", "impression_id"))
    return x.select(*CAND, R6(N.norm_max("s", "impression_id")).alias("score"))


@q("q36_emotion_history_mean", ctes("clicks") + ", l AS (SELECT user_id, generate_subscripts(embedding[1:6], 1) - 1 AS pos, unnest(embedding[1:6])::DOUBLE AS x FROM clicks JOIN embeddings ON vec_id = article) SELECT user_id, pos::INTEGER AS pos, round(avg(x), 6) + 0.0 AS x FROM l GROUP BY ALL")
def q36(spark, d):
    from ..sources.tables import vectors

    e = clicks(spark, d).join(vectors(spark, d).select("article", F.slice("vector", 1, 6).alias("v")), "article").select("user_id", F.posexplode("v").alias("pos", "x"))
    return e.groupBy("user_id", "pos").agg(R6(F.avg("x")).alias("x"))


@q("q37_name_score_norm", ctes("cand") + " SELECT impression_id, article, seller, round(quantity - median(quantity) OVER (PARTITION BY impression_id), 6) AS centred, round(quantity / max(quantity) OVER (PARTITION BY article), 6) AS scaled FROM cand")
def q37(spark, d):
    return candidates(spark, d).select(*CAND, R6(N.diff_median("quantity", "impression_id")).alias("centred"), R6(N.norm_max("quantity", "article")).alias("scaled"))


@q("q38_auc_by_segment", ctes("cand") + ", a AS (SELECT x.impression_id, avg(CASE WHEN x.price > y.price THEN 1.0 WHEN x.price = y.price THEN 0.5 ELSE 0.0 END) AS auc FROM cand x JOIN cand y ON x.impression_id = y.impression_id AND x.target = 1 AND y.target = 0 GROUP BY 1) SELECT o_orderpriority AS segment, round(avg(auc), 6) AS auc, count(*) AS n FROM a JOIN orders ON impression_id = o_orderkey GROUP BY 1")
def q38(spark, d):
    a = M.auc(candidates(spark, d), ["impression_id"], "price", "target")
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    return a.join(o, F.col("impression_id") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("segment")).agg(R6(F.avg("auc")).alias("auc"), F.count("*").alias("n"))


@q("m06_alpha_grid", ctes("cand") + ", g AS (SELECT i / 4.0 AS alpha FROM range(5) r(i)), s AS (SELECT alpha, impression_id, target, round(alpha * price / 100000 + (1 - alpha) * quantity / 50, 9) AS s FROM cand, g), a AS (SELECT x.alpha, x.impression_id, avg(CASE WHEN x.s > y.s THEN 1.0 WHEN x.s = y.s THEN 0.5 ELSE 0.0 END) AS auc FROM s x JOIN s y ON x.alpha = y.alpha AND x.impression_id = y.impression_id AND x.target = 1 AND y.target = 0 GROUP BY ALL) SELECT alpha::DOUBLE AS alpha, round(avg(auc), 6) AS auc FROM a GROUP BY 1")
def m06(spark, d):
    c = candidates(spark, d).select("impression_id", "target", "price", "quantity", F.explode(F.array(*(F.lit(i / 4) for i in range(5)))).alias("alpha"))
    c = c.withColumn("s", F.round(F.col("alpha") * F.col("price") / 100000 + (1 - F.col("alpha")) * F.col("quantity") / 50, 9))
    return M.auc(c, ["alpha", "impression_id"], "s", "target").groupBy("alpha").agg(R6(F.avg("auc")).alias("auc"))


def _training(spark, d):
    c = candidates(spark, d).join(_ratio(spark, d), "article")
    return c.select(*CAND, "target", "price", "quantity", F.col("r").alias("popularity"))


@q("m01_m02_boosted_trees")
def m01(spark, d):
    x = _training(spark, d)
    model = models.train_classifier(x.where(F.pmod(F.xxhash64("impression_id"), F.lit(5)) != 0), ["price", "quantity", "popularity"], "target")
    return models.predict(model, x, ["price", "quantity", "popularity"])


@q("m05_tuned_logistic")
def m05(spark, d):
    x = _training(spark, d)
    model = models.tuned_logistic(x, ["price", "quantity", "popularity"], "target")
    return models.predict(model.bestModel, x, ["price", "quantity", "popularity"])


@q("m07_projection")
def m07(spark, d):
    from ..sources.tables import vectors

    return models.project(vectors(spark, d), "article", "vector", 3)


@q("x03_grouped_map", "SELECT user_id, round(sum(value * value) / count(*) - pow(avg(value), 2), 4) AS variance FROM events GROUP BY 1")
def x03(spark, d):
    import pandas as pd

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [pdf["user_id"].iloc[0]], "variance": [round(float(pdf["value"].var(ddof=0)), 4)]})

    return table(spark, d, "events", "user_id", "value").groupBy("user_id").applyInPandas(spread, "user_id long, variance double")


@q("x01_x02_list_expressions", ctes("imp") + " SELECT impression_id, round(list_sum(list_transform(range(len(inview)), lambda i: inview[i + 1] * pow(0.9, len(inview) - i - 1))) / 7, 4) AS decayed FROM imp")
def x01(spark, d):
    from ..functions import lists as L
    from ..sources.tables import impressions

    w = L.exponential_decay(F.size("inview"), 0.9)
    return impressions(spark, d).select("impression_id", F.round(F.aggregate(F.zip_with("inview", w, lambda x, k: x * k), F.lit(0.0), lambda s, x: s + x) / 7, 4).alias("decayed"))
