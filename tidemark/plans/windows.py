"""Window functions (W) and time series (T)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lists as L
from ..functions import times as T
from ..operators import windows as N
from ..sources.tables import candidates, clicks, ctes, table
from .base import register as q

R6 = lambda c: F.round(c, 6)
CAND = ["impression_id", "article", "seller"]
KEYS = "impression_id, article, seller"


def _w(name, column, sql, extra=""):
    """A window column over the candidates, beside its SQL."""

    @q(name, ctes("cand") + f" SELECT {KEYS}, {sql} AS x FROM cand")
    def run(spark, d):
        return candidates(spark, d).select(*CAND, column().alias("x"))

    return run


G, U = "impression_id", "article"
_w("w01_norm_max", lambda: R6(N.norm_max("price", G)), "round(price / nullif(max(price) OVER (PARTITION BY impression_id), 0), 6)")
_w("w02_norm_sum", lambda: R6(N.norm_sum("price", G)), "round(price / nullif(sum(price) OVER (PARTITION BY impression_id), 0), 6)")
_w("w03_norm_l2", lambda: R6(N.norm_l2("price", G)), "round(price / sqrt(sum(price * price) OVER (PARTITION BY impression_id)), 6)")
_w("w03_norm_l2_literal", lambda: R6(N.norm_l2("quantity", G, literal=True)), "round(quantity / sum(quantity * quantity) OVER (PARTITION BY impression_id), 6)")
_w("w04_minus_median", lambda: R6(N.diff_median("price", G)), "round(price - median(price) OVER (PARTITION BY impression_id), 6)")
_w("w05_ratio_mean", lambda: R6(N.ratio_mean("price", G)), "round(price / nullif(avg(price) OVER (PARTITION BY impression_id), 0), 6)")
_w("w05_minus_mean", lambda: R6(N.diff_mean("quantity", G)), "round(quantity - avg(quantity) OVER (PARTITION BY impression_id), 6)")
_w("w05_ratio_quantile", lambda: R6(N.ratio_quantile("price", 0.8, G)), "round(price / nullif(quantile_cont(price, 0.8) OVER (PARTITION BY impression_id), 0), 6)")
_w("w06_diversity", lambda: N.diversity(F.when(F.col("seller") % 3 != 0, F.col("seller") % 7), G), "count(DISTINCT CASE WHEN seller % 3 <> 0 THEN seller % 7 END) OVER (PARTITION BY impression_id) + max((seller % 3 = 0)::INTEGER) OVER (PARTITION BY impression_id)")
_w("w07_rank_asc", lambda: N.rank_min(F.when(F.col("seller") % 3 != 0, F.col("quantity")), G), "CASE WHEN seller % 3 <> 0 THEN rank() OVER (PARTITION BY impression_id ORDER BY CASE WHEN seller % 3 <> 0 THEN quantity END ASC NULLS LAST)::INTEGER END")
_w("w07_rank_desc", lambda: N.rank_min("quantity", G, descending=True), "rank() OVER (PARTITION BY impression_id ORDER BY quantity DESC NULLS LAST)::INTEGER")
_w("w18_quantile_ratio_article", lambda: R6(N.ratio_quantile("quantity", 0.8, U)), "round(quantity / nullif(quantile_cont(quantity, 0.8) OVER (PARTITION BY article), 0), 6)")
_w("w23_min_max", lambda: R6(N.min_max("price", G)), "round((price - min(price) OVER (PARTITION BY impression_id)) / nullif(max(price) OVER (PARTITION BY impression_id) - min(price) OVER (PARTITION BY impression_id), 0), 6)")
_w("w24_group_count", lambda: F.count("*").over(W.partitionBy(G)), "count(*) OVER (PARTITION BY impression_id)")
_w("w28_is_max", lambda: (F.col("price") == F.max("price").over(W.partitionBy(G))), "price = max(price) OVER (PARTITION BY impression_id)")


@q("w08_group_statistics", ctes("cand") + ", m AS (SELECT impression_id, avg(price) AS m FROM cand GROUP BY 1) SELECT cand.impression_id, round(median(price), 6) AS median_price, round(avg(price), 6) AS mean_price, round(stddev_samp(price), 6) AS std_price, round(avg(pow(price - m, 3)) / nullif(pow(avg(pow(price - m, 2)), 1.5), 0), 6) AS skew_price, round(kurtosis_pop(price), 6) AS kurtosis_price FROM cand JOIN m ON cand.impression_id = m.impression_id GROUP BY 1 HAVING count(*) > 2")
def w08(spark, d):
    c = candidates(spark, d)
    big = c.groupBy("impression_id").count().where("count > 2").select("impression_id")
    s = N.group_statistics(c.join(big, "impression_id", "left_semi"), ["impression_id"], ["price"])
    return s.select("impression_id", *(R6(x).alias(x) for x in s.columns[1:]))


@q("w09_w10_normalisation_plan", ctes("cand") + f" SELECT {KEYS}, round(price / max(price) OVER i, 6) AS price_max_i, round(quantity / sum(quantity) OVER i, 6) AS quantity_sum_i, round(price / avg(price) OVER a, 6) AS price_mean_a, rank() OVER (PARTITION BY article ORDER BY price DESC)::INTEGER AS price_rank_a FROM cand WINDOW i AS (PARTITION BY impression_id), a AS (PARTITION BY article)")
def w09(spark, d):
    plan = {
        ("impression_id",): {"price_max_i": R6(N.norm_max("price", G)), "quantity_sum_i": R6(N.norm_sum("quantity", G))},
        ("article",): {"price_mean_a": R6(N.ratio_mean("price", U)), "price_rank_a": N.rank_min("price", U, descending=True)},
    }
    return N.normalise_all(candidates(spark, d), plan).select(*CAND, "price_max_i", "quantity_sum_i", "price_mean_a", "price_rank_a")


_MINUTES = "m AS (SELECT user_id, date_trunc('minute', ts + INTERVAL 30 SECOND) AS minute, count(*) AS n FROM events GROUP BY ALL)"


def _minutes(spark, d, *more):
    return table(spark, d, "events", "user_id", "ts", *more).groupBy("user_id", *more, T.nearest_minute("ts").alias("minute")).agg(F.count("*").alias("n"))


@q("w11_endorsement_10h", f"WITH {_MINUTES} SELECT user_id, minute, (sum(n) OVER (PARTITION BY user_id ORDER BY minute RANGE BETWEEN INTERVAL 599 MINUTE PRECEDING AND CURRENT ROW))::BIGINT AS endorsement FROM m")
def w11(spark, d):
    return _minutes(spark, d).select("user_id", "minute", N.rolling_time(F.col("n"), ["user_id"], "minute", 36000).alias("endorsement"))


@q("w12_endorsement_20h_pair", "WITH m AS (SELECT user_id, event_type, date_trunc('minute', ts + INTERVAL 30 SECOND) AS minute, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, minute, (sum(n) OVER (PARTITION BY user_id, event_type ORDER BY minute RANGE BETWEEN INTERVAL 1199 MINUTE PRECEDING AND CURRENT ROW))::BIGINT AS endorsement FROM m")
def w12(spark, d):
    return _minutes(spark, d, "event_type").select("user_id", "event_type", "minute", N.rolling_time(F.col("n"), ["user_id", "event_type"], "minute", 72000).alias("endorsement"))


_DAYS = "c AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT event_type, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM c GROUP BY 1), f AS (SELECT s.event_type, s.day, coalesce(n, 0) AS n FROM s LEFT JOIN c ON s.event_type = c.event_type AND s.day = c.day)"


def _daily(spark, d):
    e = table(spark, d, "events", "user_id", "event_type", "ts")
    c = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return N.daily_spine(c, ["event_type"], "day", "n")


@q("w13_daily_rolling", f"WITH {_DAYS} SELECT event_type, day, (sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS n3 FROM f")
def w13(spark, d):
    return _daily(spark, d).select("event_type", "day", N.rolling_rows(F.sum, "n", ["event_type"], ["day"], 3).alias("n3"))


@q("t05_upsampled_calendar", f"WITH {_DAYS} SELECT event_type, day, n FROM f")
def t05(spark, d):
    return _daily(spark, d).select("event_type", "day", "n")


@q("w14_latest_per_key", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def w14(spark, d):
    e = table(spark, d, "events", "user_id", "event_id", "ts")
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("s")).select("user_id", "s.event_id", "s.ts")


@q("w15_w16_w17_rolling_rows", "SELECT event_id, round(avg(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5, round(avg(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - avg(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS macd, max(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS max10 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)".replace("(w ROWS", "(PARTITION BY user_id ORDER BY ts, event_id ROWS").replace(" WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", ""))
def w15(spark, d):
    by, order = ["user_id"], ["ts", "event_id"]
    return table(spark, d, "events", "event_id", "user_id", "ts", "value").select("event_id", R6(N.rolling_rows(F.avg, "value", by, order, 5)).alias("mean5"), R6(N.macd("value", by, order)).alias("macd"), N.rolling_rows(F.max, "value", by, order, 10).alias("max10"))


@q("w19_time_rolling_mean", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 6) AS diff FROM events")
def w19(spark, d):
    w = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    return table(spark, d, "events", "event_id", "user_id", "ts", "value").select("event_id", R6(F.col("value") - F.avg("value").over(w)).alias("diff"))


@q("w19_time_rolling_mean_global", "SELECT event_id, round(value - avg(value) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), 6) AS diff FROM events")
def w19g(spark, d):
    e = N.global_rolling_mean(table(spark, d, "events", "event_id", "ts", "value"), "ts", "value", 3600, "m")
    return e.select("event_id", R6(F.col("value") - F.col("m")).alias("diff"))


@q("w20_w21_lag_lead", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_value, lead(event_id) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS next_id FROM events")
def w20(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "value").withColumn("day", F.to_date("ts"))
    return e.select("event_id", F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("last_value"), F.lead("event_id").over(W.partitionBy("user_id", "day").orderBy("ts", "event_id")).alias("next_id"))


@q("w22_dynamic_history", "SELECT event_id, '[' || coalesce(array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') || ']' AS history FROM events")
def w22(spark, d):
    return table(spark, d, "events", "event_id", "user_id", "ts").select("event_id", L.text(N.previous_rows("event_id", ["user_id"], ["ts", "event_id"], 3)).alias("history"))


@q("w25_top_flags", ctes("cand") + f", r AS (SELECT {KEYS}, rank() OVER (PARTITION BY impression_id ORDER BY price DESC) AS p, rank() OVER (PARTITION BY impression_id ORDER BY quantity DESC) AS q FROM cand) SELECT {KEYS}, (p <= 1)::INTEGER + (q <= 1)::INTEGER AS top1, (p <= 3)::INTEGER + (q <= 3)::INTEGER AS top3 FROM r")
def w25(spark, d):
    p, k = N.rank_min("price", G, descending=True), N.rank_min("quantity", G, descending=True)
    votes = lambda n: (p <= n).cast("int") + (k <= n).cast("int")
    return candidates(spark, d).select(*CAND, votes(1).alias("top1"), votes(3).alias("top3"))


@q("w26_normalised_day_trend", "SELECT event_id, round(value / max(value) OVER (PARTITION BY ts::DATE), 6) AS trend FROM events")
def w26(spark, d):
    e = table(spark, d, "events", "event_id", "ts", "value").withColumn("day", F.to_date("ts"))
    return e.select("event_id", R6(N.norm_max("value", "day")).alias("trend"))


@q("w27_group_row_index", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events")
def w27(spark, d):
    return table(spark, d, "events", "event_id", "user_id", "ts").select("event_id", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("place"))


@q("t01_tumbling_sessions", "SELECT event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT // 1800)::INTEGER AS session FROM events".replace("epoch(ts)::BIGINT // 1800", "floor(epoch(ts) / 1800)"))
def t01(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts").withColumn("slot", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800))
    return e.select("event_id", F.dense_rank().over(W.partitionBy("user_id").orderBy("slot")).alias("session"))


@q("t02_gap_sessions", "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k")
def t02(spark, d):
    e = table(spark, d, "events", "user_id", "ts", "value")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), R6(F.sum("value")).alias("total"))
    return s.select("user_id", F.col("w.start").alias("started"), "n", "total")


@q("t03_session_summary", "WITH s AS (SELECT user_id, floor(epoch(ts) / 1800)::BIGINT AS slot, max(ts) AS last_ts, date_sub('minute', min(ts), max(ts)) AS minutes, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS seen FROM events GROUP BY ALL) SELECT user_id, slot, last_ts, minutes, seen FROM s")
def t03(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts").withColumn("slot", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800))
    s = e.groupBy("user_id", "slot").agg(F.max("ts").alias("last_ts"), F.min("ts").alias("first_ts"), F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("s"))
    return s.select("user_id", "slot", "last_ts", T.between("MINUTE", "first_ts", "last_ts").alias("minutes"), F.array_join(F.transform("s", lambda x: x.event_id.cast("string")), ",").alias("seen"))


@q("t04_sliding_window", "WITH x AS (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR, time_bucket(INTERVAL 6 HOUR, ts), INTERVAL 6 HOUR)) AS started FROM events) SELECT event_type, started, count(*) AS n FROM x GROUP BY ALL")
def t04(spark, d):
    e = table(spark, d, "events", "event_type", "ts").groupBy("event_type", F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("event_type", F.col("w.start").alias("started"), "n")


@q("t06_moving_folds", "SELECT fold::BIGINT AS fold, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-05 07:00:00' + fold * INTERVAL 2 DAY) AS train, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05 07:00:00' + fold * INTERVAL 2 DAY) AS val FROM events, range(5) r(fold) WHERE ts >= TIMESTAMP '2024-01-01 07:00:00' + fold * INTERVAL 2 DAY AND ts < TIMESTAMP '2024-01-07 07:00:00' + fold * INTERVAL 2 DAY GROUP BY 1")
def t06(spark, d):
    from ..operators.histories import moving_folds

    e = moving_folds(table(spark, d, "events", "ts"), "ts", start="2024-01-01 07:00:00", train_days=4, val_days=2, stride=2, folds=5)
    return e.groupBy("fold").agg(F.count_if(~F.col("val")).alias("train"), F.count_if("val").alias("val"))


@q("t07_t08_fixed_history", ctes("clicks") + ", h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, impression_id DESC, article DESC, seller DESC) AS rn FROM clicks WHERE ts < TIMESTAMP '2000-01-01') SELECT user_id, '[' || string_agg(article::VARCHAR, ',' ORDER BY ts, impression_id, article, seller) || ']' AS items, '[' || string_agg(quantity::BIGINT::VARCHAR, ',' ORDER BY ts, impression_id, article, seller) || ']' AS amounts FROM h WHERE rn <= 5 GROUP BY 1")
def t07(spark, d):
    from ..operators.histories import fixed_history

    h = fixed_history(clicks(spark, d).where("ts < '2000-01-01'"), "user_id", ["ts", "impression_id", "article", "seller"], ["article", "quantity"], 5)
    return h.select("user_id", L.text("history.article").alias("items"), L.text(F.transform("history.quantity", lambda x: x.cast("long"))).alias("amounts"))


@q("t10_history_lists", ctes("clicks") + " SELECT user_id, '[' || string_agg(article::VARCHAR, ',' ORDER BY ts, impression_id, article, seller) || ']' AS items FROM clicks GROUP BY 1")
def t10(spark, d):
    from ..operators.histories import history

    return history(clicks(spark, d), "user_id", ["ts", "impression_id", "article", "seller"], ["article"]).select("user_id", L.text("history.article").alias("items"))


@q("t11_merge_histories", ctes("clicks") + ", a AS (SELECT user_id, ts, article, seller, impression_id FROM clicks WHERE ts < TIMESTAMP '1999-01-01'), b AS (SELECT user_id, ts, article, seller, impression_id FROM clicks WHERE ts >= TIMESTAMP '1998-01-01'), m AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.user_id = b.user_id AND a.ts = b.ts) UNION ALL SELECT * FROM b) SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM m GROUP BY 1")
def t11(spark, d):
    from ..operators.histories import merge_histories

    c = clicks(spark, d).select("user_id", "ts", "article", "seller", "impression_id")
    m = merge_histories(c.where("ts < '1999-01-01'"), c.where("ts >= '1998-01-01'"), ["user_id", "ts"])
    return m.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@q("t12_sequence_windows", "WITH e AS (SELECT conv_id, turn, length(text) AS n, lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS target, list(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS w FROM conversations) SELECT conv_id, turn, '[' || array_to_string(list_concat(list_resize([]::BIGINT[], 4 - len(w), 0), w), ',') || ']' AS inputs, target FROM e WHERE target IS NOT NULL")
def t12(spark, d):
    from ..operators.histories import sequence_windows

    c = table(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    s = sequence_windows(c, "conv_id", "turn", "n", 4)
    return s.select("conv_id", "turn", L.text("inputs").alias("inputs"), "target")


@q("t13_history_slice", ctes("clicks") + ", h AS (SELECT user_id, list(article ORDER BY ts, impression_id, article, seller) AS a FROM clicks GROUP BY 1) SELECT user_id, '[' || array_to_string(a[greatest(len(a) // 2 - 2, 1):len(a) // 2], ',') || ']' AS part FROM h WHERE len(a) >= 2")
def t13(spark, d):
    from ..operators.histories import history

    h = history(clicks(spark, d), "user_id", ["ts", "impression_id", "article", "seller"], ["article"]).select("user_id", F.col("history.article").alias("a")).where(F.size("a") >= 2)
    end = F.expr("size(a) div 2").cast("int")
    start = F.greatest(end - 2, F.lit(1))
    return h.select("user_id", L.text(F.slice("a", start, end - start + 1)).alias("part"))


@q("t14_watermarked_counts", "SELECT * FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS started, count(*) AS n FROM events GROUP BY ALL) WHERE started + INTERVAL 1 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR")
def t14(spark, d):
    from ..streaming.windows import hourly_counts_from_files

    return hourly_counts_from_files(spark, d)
