"""Scans and sinks (S), projections and predicates (P), list and scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lists as L
from ..functions import scalars as K
from ..functions import times as T
from ..sources.tables import candidates, clicks, ctes, dataset, impressions, items, table
from .base import register as q

R6 = lambda c: F.round(c, 6)


@q("s01_read_parquet", "SELECT p_partkey, p_name, p_retailprice FROM part")
def s01(spark, d):
    return table(spark, d, "part", "p_partkey", "p_name", "p_retailprice")


@q("s03_dataset_loader", "SELECT 'customer' AS name, count(*) AS n_rows FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def s03(spark, d):
    found = dataset(spark, d, ("customer", "nation", "orders"))
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n, df in found.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@q("s06_merge_splits", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN o_totalprice END AS price, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_orderpriority END AS priority FROM orders")
def s06(spark, d):
    o = table(spark, d, "orders")
    train = o.where("o_orderdate < '1998-01-01'").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    test = o.where("o_orderdate >= '1998-01-01'").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("priority"))
    return train.unionByName(test, allowMissingColumns=True)


@q("s12_submission_lines", ctes("cand") + ", r AS (SELECT impression_id, row_number() OVER (PARTITION BY impression_id ORDER BY price DESC, article, seller) AS rank, position, article, seller FROM cand) SELECT impression_id::VARCHAR || ' [' || string_agg(rank::VARCHAR, ',' ORDER BY position, article, seller) || ']' AS line FROM r GROUP BY impression_id")
def s12(spark, d):
    from ..sources.sinks import submission_lines

    return submission_lines(candidates(spark, d), "impression_id", "price", ["position", "article", "seller"], ["article", "seller"])


@q("s12_submission_reader", ctes("cand") + ", r AS (SELECT impression_id, row_number() OVER (PARTITION BY impression_id ORDER BY price DESC, article, seller) AS rank, row_number() OVER (PARTITION BY impression_id ORDER BY position, article, seller) AS place FROM cand) SELECT impression_id, place::INTEGER AS place, rank::INTEGER AS rank FROM r")
def s12b(spark, d):
    from ..sources.sinks import parse_submission

    return parse_submission(s12(spark, d))


@q("s17_binned_feature", ctes("cand") + ", b AS (SELECT *, ntile(16) OVER (ORDER BY p_retailprice, p_partkey) AS bin FROM part) SELECT impression_id, article, seller, bin::INTEGER AS bin, target FROM cand JOIN b ON article = p_partkey")
def s17(spark, d):
    from ..operators.sampling import global_ntile

    bins = global_ntile(table(spark, d, "part", "p_partkey", "p_retailprice"), 16, ["p_retailprice", "p_partkey"], "bin").select(F.col("p_partkey").alias("article"), "bin")
    return candidates(spark, d).join(bins, "article").select("impression_id", "article", "seller", "bin", "target")


@q("s18_gain_weights", "SELECT event_id, greatest(coalesce(CASE WHEN event_type <> 'error' THEN value END, 0) / 100, 0.1) AS weight FROM events")
def s18(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", K.gain_weight(F.when(F.col("event_type") != "error", F.col("value"))).alias("weight"))


@q("s19_id_value_map", "SELECT row_number() OVER (ORDER BY c_mktsegment) - 1 AS code, c_mktsegment AS value FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def s19(spark, d):
    from ..operators.sampling import dense_index

    return dense_index(table(spark, d, "customer", "c_mktsegment").distinct(), ["c_mktsegment"], "code").select("code", F.col("c_mktsegment").alias("value"))


@q("s20_restore_timestamp", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def s20(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_totalprice").join(o.select("o_orderkey", "o_orderdate"), "o_orderkey", "left")


@q("p01_rename_ignore_missing", "SELECT p_partkey AS article, p_brand AS category, p_size FROM part")
def p01(spark, d):
    return table(spark, d, "part", "p_partkey", "p_brand", "p_size").withColumnsRenamed({"p_partkey": "article", "p_brand": "category", "absent": "x"})


@q("p02_prefix_columns", "SELECT c_custkey, c_acctbal AS last_c_acctbal, c_nationkey AS last_c_nationkey FROM customer")
def p02(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey")
    return c.select("c_custkey", *(F.col(x).alias(f"last_{x}") for x in c.columns if x != "c_custkey"))


@q("p04_dtype_selector", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def p04(spark, d):
    s = table(spark, d, "supplier")
    return s.select(*(n for n, t in s.dtypes if t in ("int", "bigint", "double", "float")))


@q("p05_filter_to_list", "SELECT p_partkey, CASE WHEN p_size IN (1, 5, 10, 20) THEN p_size END AS p_size FROM part")
def p05(spark, d):
    return table(spark, d, "part", "p_partkey", "p_size").withColumn("p_size", F.when(F.col("p_size").isin(1, 5, 10, 20), F.col("p_size")))


@q("p06_known_user_flag", "SELECT c_custkey, c_custkey IN (SELECT user_id FROM events) AS known FROM customer")
def p06(spark, d):
    known = table(spark, d, "events", "user_id").distinct().withColumn("known", F.lit(True))
    return table(spark, d, "customer", "c_custkey").join(known, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", F.coalesce("known", F.lit(False)).alias("known"))


@q("p07_min_value_filter", "SELECT event_id, value FROM events WHERE value >= 50")
def p07(spark, d):
    return table(spark, d, "events", "event_id", "value").where("value >= 50")


@q("p08_list_length_filter", ctes("imp") + " SELECT impression_id, len(inview) AS n FROM imp WHERE len(inview) >= 3 AND len(inview) <= 6")
def p08(spark, d):
    return impressions(spark, d).select("impression_id", F.size("inview").cast("long").alias("n")).where("n >= 3 and n <= 6")


@q("p09_min_negatives", ctes("imp") + " SELECT impression_id, len(inview) - len(clicked) AS negatives FROM imp WHERE len(inview) - len(clicked) >= 2")
def p09(spark, d):
    return impressions(spark, d).select("impression_id", (F.size("inview") - F.size("clicked")).cast("long").alias("negatives")).where("negatives >= 2")


@q("p10_non_empty_text", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0")
def p10(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.length("text").cast("long").alias("n")).where("n > 0")


@q("p11_case_sentiment", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS sentiment FROM events")
def p11(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events", "event_id", "event_type").select("event_id", F.when(kind == "purchase", 1).when(kind == "error", -1).otherwise(0).alias("sentiment"))


@q("p12_score_rules", "SELECT p_partkey, round(p_retailprice * CASE WHEN p_size > 30 THEN 1.2 ELSE 1 END * CASE WHEN p_brand = 'Brand#11' THEN 0.5 ELSE 1 END * CASE WHEN p_name LIKE '%red%' THEN 1.1 ELSE 1 END, 6) AS score FROM part")
def p12(spark, d):
    score = F.col("p_retailprice")
    for rule, factor in ((F.col("p_size") > 30, 1.2), (F.col("p_brand") == "Brand#11", 0.5), (F.col("p_name").contains("red"), 1.1)):
        score = F.when(rule, score * factor).otherwise(score)
    return table(spark, d, "part").select("p_partkey", R6(score).alias("score"))


@q("p13_fill_null", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, -1.0) AS balance FROM customer")
def p13(spark, d):
    return table(spark, d, "customer", "c_custkey", "c_acctbal").select("c_custkey", F.coalesce(F.nanvl(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.lit(None).cast("double")), F.lit(-1.0)).alias("balance"))


@q("p14_finite_only", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN round(value, 6) END AS value FROM events")
def p14(spark, d):
    x = F.when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.round("value", 6))
    return table(spark, d, "events", "event_id", "value").select("event_id", K.finite(x).alias("value"))


@q("p15_inf_audit", "SELECT 'a' AS name, count(*) FILTER (WHERE event_id % 7 = 0) AS n FROM events UNION ALL SELECT 'b', count(*) FILTER (WHERE event_id % 11 = 0) FROM events")
def p15(spark, d):
    e = table(spark, d, "events", "event_id", "value")
    inf = F.lit(float("inf"))
    e = e.select(*(F.when(F.col("event_id") % k == 0, inf).otherwise(F.col("value")).alias(n) for n, k in (("a", 7), ("b", 11))))
    return e.agg(*(F.count_if(F.abs(c) == inf).alias(c) for c in e.columns)).unpivot([], ["a", "b"], "name", "n")


@q("p17_concat_strings", "SELECT p_partkey, p_brand || ' ' || p_type AS spaced, p_brand || '_' || p_type AS joined FROM part")
def p17(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit(" "), "p_type").alias("spaced"), F.concat("p_brand", F.lit("_"), "p_type").alias("joined"))


@q("p18_fold_ids", "SELECT o_orderkey, o_orderkey::VARCHAR || CASE WHEN o_custkey % 2 = 0 THEN '_1' ELSE '_2' END AS fold_id FROM orders")
def p18(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_custkey") % 2 == 0, "_1").otherwise("_2")).alias("fold_id"))


@q("p19_substring_predicate", "SELECT page_id, contains(url, '/en/') AS english, regexp_matches(url, '/[0-9]+\\.html') AS page FROM pages")
def p19(spark, d):
    return table(spark, d, "pages", "page_id", "url").select("page_id", F.col("url").contains("/en/").alias("english"), F.col("url").rlike(r"/[0-9]+\.html").alias("page"))


@q("p20_row_index", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_index, c_custkey FROM customer")
def p20(spark, d):
    from ..operators.sampling import dense_index

    return dense_index(table(spark, d, "customer", "c_custkey"), ["c_custkey"], "row_index")


@q("p22_drop_features", "SELECT s_suppkey, s_name FROM supplier")
def p22(spark, d):
    return table(spark, d, "supplier").drop("s_acctbal", "s_nationkey", "absent")


@q("p24_lookup_default", "SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def p24(spark, d):
    known = table(spark, d, "nation", "n_nationkey", "n_name").where("n_nationkey < 20")
    return table(spark, d, "customer", "c_custkey", "c_nationkey").join(known, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@q("p25_from_dict", "SELECT * FROM (VALUES ('a', 1::BIGINT), ('b', 2), ('c', 3)) t(name, value)")
def p25(spark, d):
    return spark.createDataFrame(list({"a": 1, "b": 2, "c": 3}.items()), "name string, value long")


@q("p29_code_name_pairs", "SELECT DISTINCT n_nationkey AS code, n_name AS name FROM nation WHERE n_name IS NOT NULL")
def p29(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")).dropna().distinct()


#: name: (columns of the query, the same in SQL), over impressions.
_LISTS = {
    "f01_list_length": (lambda: [F.size("inview").cast("long").alias("n"), F.size("clicked").cast("long").alias("k")], "len(inview) AS n, len(clicked) AS k"),
    "f02_list_contains": (lambda: [L.contains("inview", 7).alias("constant"), L.contains("inview", F.col("user_id")).alias("other")], "coalesce(list_contains(inview, 7), false) AS constant, coalesce(list_contains(inview, user_id), false) AS other"),
    "f03_share_of_constant": (lambda: [R6(L.share_of("inview", 11)).alias("share")], "CASE WHEN len(inview) > 0 THEN round(len(list_filter(inview, lambda x: x = 11))::DOUBLE / len(inview), 6) ELSE 0.0 END AS share"),
    "f04_share_matching_column": (lambda: [R6(L.share_matching("inview", F.element_at("inview", 1))).alias("share")], "round((len(inview) - len(list_distinct(list_filter(inview, lambda x: x <> inview[1]))))::DOUBLE / len(inview), 6) AS share"),
    "f05_list_shapes": (lambda: [L.text(F.array_sort(F.array_distinct("inview"))).alias("uniq"), L.text(F.reverse("inview")).alias("back"), F.element_at("inview", 1).alias("head"), F.element_at("inview", -1).alias("tail"), L.text(L.tail("inview", 3)).alias("tail3"), L.text(F.slice("inview", 2, 2)).alias("mid"), F.array_join("inview", "|").alias("joined")], "'[' || array_to_string(list_sort(list_distinct(inview)), ',') || ']' AS uniq, '[' || array_to_string(list_reverse(inview), ',') || ']' AS back, inview[1] AS head, inview[-1] AS tail, '[' || array_to_string(inview[greatest(len(inview) - 2, 1):], ',') || ']' AS tail3, '[' || array_to_string(inview[2:3], ',') || ']' AS mid, array_to_string(inview, '|') AS joined"),
    "f06_keep_unique": (lambda: [L.text(F.array_distinct("inview")).alias("kept")], "(SELECT '[' || string_agg(x::VARCHAR, ',' ORDER BY p) || ']' FROM (SELECT x, min(p) AS p FROM (SELECT unnest(inview) AS x, generate_subscripts(inview, 1) AS p) GROUP BY x)) AS kept"),
    "f07_drop_nulls": (lambda: [L.text(F.array_compact(F.transform("inview", lambda x: F.when(x % 3 != 0, x)))).alias("kept")], "'[' || array_to_string(list_filter(inview, lambda x: x % 3 <> 0), ',') || ']' AS kept"),
    "f08_filter_by_ids": (lambda: [L.text(L.keep_in("inview", list(range(0, 400, 2)))).alias("kept")], "'[' || array_to_string(nullif(list_filter(inview, lambda x: x % 2 = 0 AND x < 400), []), ',') || ']' AS kept"),
    "f09_list_aggregates": (lambda: [R6(L.total("inview")).alias("total"), R6(L.mean("inview")).alias("mean"), F.array_min("inview").alias("low"), F.array_max("inview").alias("high"), R6(L.deviation("inview")).alias("std")], "list_sum(inview)::DOUBLE AS total, round(list_avg(inview), 6) AS mean, list_min(inview) AS low, list_max(inview) AS high, round(list_aggregate(inview, 'stddev_samp'), 6) AS std"),
    "f10_pad_history": (lambda: [L.text(L.pad_left("inview", 5, 0)).alias("padded")], "'[' || array_to_string(list_concat(list_resize([]::BIGINT[], greatest(5 - len(inview), 0), 0), inview[greatest(len(inview) - 4, 1):]), ',') || ']' AS padded"),
    "f11_remove_positives": (lambda: [L.text(L.without("inview", "clicked")).alias("kept")], "'[' || array_to_string(list_filter(inview, lambda x: NOT list_contains(clicked, x)), ',') || ']' AS kept"),
    "f12_binary_labels": (lambda: [L.text(L.labels("inview", "clicked")).alias("labels")], "'[' || array_to_string(list_transform(inview, lambda x: list_contains(clicked, x)::INTEGER), ',') || ']' AS labels"),
    "f15_concat_struct": (lambda: [L.text(F.concat("inview", "clicked")).alias("both"), F.struct(F.size("inview").alias("n"), F.col("user_id").alias("u")).getField("u").alias("field")], "'[' || array_to_string(list_concat(inview, clicked), ',') || ']' AS both, user_id AS field"),
    "f16_multi_hot": (lambda: [L.text(L.multi_hot("inview", [1, 2, 3, 4, 5])).alias("hot")], "'[' || array_to_string(list_transform([1, 2, 3, 4, 5], lambda v: list_contains(inview, v)::INTEGER), ',') || ']' AS hot"),
    "f31_decay_weights": (lambda: [L.text(F.transform(L.linear_decay(F.size("inview")), lambda x: F.round(x * 1e6).cast("long"))).alias("linear"), L.text(F.transform(L.exponential_decay(F.size("inview"), 0.5), lambda x: F.round(x * 1e6).cast("long"))).alias("exponential")], "'[' || array_to_string(list_transform(range(len(inview)), lambda i: round((len(inview) - i)::DOUBLE / len(inview) * 1000000)::BIGINT), ',') || ']' AS linear, '[' || array_to_string(list_transform(range(len(inview)), lambda i: round(pow(0.5, len(inview) - i - 1) * 1000000)::BIGINT), ',') || ']' AS exponential"),
    "f33_weighted_list": (lambda: [R6(F.aggregate(F.zip_with("inview", L.linear_decay(F.size("inview")), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)).alias("weighted")], "round(list_sum(list_transform(range(len(inview)), lambda i: inview[i + 1] * ((len(inview) - i)::DOUBLE / len(inview)))), 6) AS weighted"),
    "f36_jaccard": (lambda: [R6(L.jaccard("inview", "clicked")).alias("jaccard")], "round(len(list_intersect(inview, clicked))::DOUBLE / nullif(len(list_distinct(list_concat(inview, clicked))), 0), 6) AS jaccard"),
    "u05_list_sets": (lambda: [L.text(F.array_sort(F.array_intersect("inview", "clicked"))).alias("both"), L.text(F.array_sort(F.array_union("inview", "clicked"))).alias("any"), L.text(F.array_sort(F.array_except("inview", "clicked"))).alias("rest")], "'[' || array_to_string(list_sort(list_intersect(inview, clicked)), ',') || ']' AS both, '[' || array_to_string(list_sort(list_distinct(list_concat(inview, clicked))), ',') || ']' AS any, '[' || array_to_string(list_sort(list_distinct(list_filter(inview, lambda x: NOT list_contains(clicked, x)))), ',') || ']' AS rest"),
    "w27_list_index": (lambda: [L.text(F.transform("inview", lambda x, i: i)).alias("places")], "'[' || array_to_string(range(len(inview)), ',') || ']' AS places"),
}


def _list_query(columns):
    return lambda spark, d: impressions(spark, d).select("impression_id", *columns())


for _name, (_columns, _sql) in _LISTS.items():
    q(_name, ctes("imp") + f" SELECT impression_id, {_sql} FROM imp")(_list_query(_columns))


@q("f13_attach_scores", ctes("cand") + " SELECT impression_id, '[' || string_agg(round(price)::BIGINT::VARCHAR, ',' ORDER BY position, article, seller) || ']' AS scores FROM cand GROUP BY impression_id")
def f13(spark, d):
    c = candidates(spark, d)
    s = c.groupBy("impression_id").agg(F.array_sort(F.collect_list(F.struct("position", "article", "seller", F.round("price").cast("long").alias("score")))).alias("s"))
    return s.select("impression_id", L.text("s.score").alias("scores"))


@q("f14_explode_aligned", ctes("imp") + " SELECT impression_id, unnest(inview) AS article, unnest(list_transform(inview, lambda x: list_contains(clicked, x)::INTEGER)) AS label FROM imp")
def f14(spark, d):
    i = impressions(spark, d).withColumn("label", L.labels("inview", "clicked"))
    return i.select("impression_id", F.inline(F.arrays_zip(F.col("inview").alias("article"), "label")))


@q("f17_token_count", "SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents")
def f17(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(F.split("text", " ", -1)).cast("long").alias("n"))


@q("f18_join_underscore", ctes("items") + " SELECT article, array_to_string(list_transform(topics, lambda x: replace(x || ' x', ' ', '_')), ',') AS topics FROM items")
def f18(spark, d):
    return items(spark, d).select("article", F.array_join(F.transform("topics", lambda x: F.replace(F.concat(x, F.lit(" x")), F.lit(" "), F.lit("_"))), ",").alias("topics"))


@q("f19_concat_list", ctes("items") + " SELECT article, array_to_string(topics, ' ') AS name FROM items")
def f19(spark, d):
    return items(spark, d).select("article", F.array_join("topics", " ").alias("name"))


@q("f20_clean_names", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(text, ' '), lambda x: lower(trim(regexp_replace(x, '^\"+', ''), ' '))), lambda x: x <> ''))), ' ') AS names FROM documents")
def f20(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", F.array_join(L.clean_names(F.split("text", " ", -1)), " ").alias("names"))


@q("f21_f22_text_lengths", "SELECT doc_id, length(replace(text, chr(10), '')) AS n, length(text || lang || source) AS total FROM documents")
def f21(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.length(F.replace("text", F.lit("\n"), F.lit(""))).cast("long").alias("n"), F.length(F.concat("text", "lang", "source")).cast("long").alias("total"))


@q("f23_f28_time_parts", "SELECT event_id, ts::DATE AS day, hour(ts)::INTEGER AS hour, isodow(ts)::INTEGER AS weekday, date_trunc('minute', ts + INTERVAL 30 SECOND) AS minute, date_trunc('hour', ts + INTERVAL 30 MINUTE) AS rounded, (hour(ts) // 4)::INTEGER AS hour_group, isodow(ts) > 5 AS weekend, hour(ts) >= 5 AND hour(ts) < 13 AS morning, hour(ts) >= 22 OR hour(ts) < 6 AS night FROM events")
def f23(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events", "event_id", "ts").select(
        "event_id", F.to_date(ts).alias("day"), F.hour(ts).alias("hour"), T.iso_weekday(ts).alias("weekday"), T.nearest_minute(ts).alias("minute"), T.nearest_hour(ts).alias("rounded"),
        T.hour_group(ts).alias("hour_group"), T.is_weekend(ts).alias("weekend"), T.in_part(ts, "morning").alias("morning"), T.in_part(ts, "night").alias("night"),
    )


@q("f25_f26_time_arithmetic", "SELECT l_orderkey, l_partkey, l_suppkey, date_sub('day', o_orderdate, l_shipdate) AS days, date_sub('hour', l_shipdate, o_orderdate) AS hours, (l_shipdate - INTERVAL 10 HOUR) AS earlier, (l_shipdate::DATE - 1)::DATE AS yesterday FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def f25(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate").join(table(spark, d, "orders", "o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select("l_orderkey", "l_partkey", "l_suppkey", T.between("DAY", "o_orderdate", "l_shipdate").alias("days"), T.between("HOUR", "l_shipdate", "o_orderdate").alias("hours"), (F.col("l_shipdate") - F.expr("INTERVAL 10 HOURS")).alias("earlier"), F.date_sub("l_shipdate", 1).alias("yesterday"))


@q("f29_horizontal", "SELECT l_orderkey, l_partkey, l_suppkey, round(coalesce(a, 0) + coalesce(b, 0) + c, 6) AS total, round((coalesce(a, 0) + coalesce(b, 0) + c) / ((a IS NOT NULL)::INTEGER + (b IS NOT NULL)::INTEGER + 1), 6) AS mean, least(a, b, c) AS low, greatest(a, b, c) AS high, (c > 1 AND coalesce(b, 1) > 0) AS everything FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN l_tax END AS a, CASE WHEN l_linenumber > 2 THEN l_discount END AS b, l_quantity AS c FROM lineitem)")
def f29(spark, d):
    x = table(spark, d, "lineitem").withColumns({"a": F.when(F.col("l_returnflag") == "R", F.col("l_tax")), "b": F.when(F.col("l_linenumber") > 2, F.col("l_discount")), "c": F.col("l_quantity")})
    cols = [F.col(n) for n in "abc"]
    return x.select("l_orderkey", "l_partkey", "l_suppkey", R6(K.sum_of(*cols)).alias("total"), R6(K.mean_of(*cols)).alias("mean"), F.least(*cols).alias("low"), F.greatest(*cols).alias("high"), ((cols[2] > 1) & (F.coalesce(cols[1], F.lit(1.0)) > 0)).alias("everything"))


@q("f30_arithmetic", "SELECT p_partkey, round(pow(p_size, 1.5), 6) AS power, round(sqrt(p_size), 6) AS root, round(exp(-p_size / 10.0), 6) AS e, round(ln(p_retailprice), 6) AS l, least(greatest(p_retailprice, 950.0), 1500.0) AS clipped, (p_size // 7)::BIGINT AS whole FROM part")
def f30(spark, d):
    s, p = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", R6(F.pow(s, F.lit(1.5))).alias("power"), R6(F.sqrt(s)).alias("root"), R6(F.exp(-s / 10.0)).alias("e"), R6(F.ln(p)).alias("l"), K.clip(p, 950.0, 1500.0).alias("clipped"), F.expr("p_size div 7").alias("whole"))


@q("f37_min_max_scale", "SELECT p_partkey, round((p_retailprice - lo) / nullif(hi - lo, 0), 6) AS price, round((p_size - slo)::DOUBLE / nullif(shi - slo, 0), 6) AS size FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, min(p_size) AS slo, max(p_size) AS shi FROM part)")
def f37(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_retailprice", "p_size")
    ends = p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"), F.min("p_size").alias("slo"), F.max("p_size").alias("shi"))
    # One row of four numbers: a broadcast of proven size.
    p = p.crossJoin(F.broadcast(ends))
    return p.select("p_partkey", R6(F.try_divide(F.col("p_retailprice") - F.col("lo"), F.col("hi") - F.col("lo"))).alias("price"), R6(F.try_divide(F.col("p_size") - F.col("slo"), F.col("shi") - F.col("slo"))).alias("size"))


@q("f38_rescale", "SELECT p_partkey, round(-1 + (p_size - 1) / 49.0 * 2, 6) AS x FROM part")
def f38(spark, d):
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", R6(K.rescale(F.col("p_size"), F.lit(1), F.lit(50), -1.0, 1.0)).alias("x"))


@q("f40_stick_breaking", "WITH RECURSIVE s(i, w, r) AS (SELECT 1, 0.5::DOUBLE, 0.5::DOUBLE UNION ALL SELECT i + 1, r * CASE WHEN i = 1 THEN 0.4 ELSE 0.3 END, r - r * CASE WHEN i = 1 THEN 0.4 ELSE 0.3 END FROM s WHERE i < 3) SELECT i::INTEGER AS i, round(w, 6) AS weight FROM s")
def f40(spark, d):
    weights, rest = [], 1.0
    for p in (0.5, 0.4, 0.3):
        weights.append(rest * p)
        rest -= rest * p
    return spark.createDataFrame([(i + 1, round(w, 6)) for i, w in enumerate(weights)], "i int, weight double")


@q("f41_blended_score", ctes("cand") + " SELECT impression_id, article, seller, round(0.5 * price / 1000 + 0.3 * quantity + 0.2 * (position), 6) AS score FROM cand")
def f41(spark, d):
    return candidates(spark, d).select("impression_id", "article", "seller", R6(0.5 * F.col("price") / 1000 + 0.3 * F.col("quantity") + 0.2 * F.col("position")).alias("score"))


@q("f42_laplace_frequency", ctes("clicks") + ", k AS (SELECT DISTINCT p_brand FROM part), u AS (SELECT user_id, count(*) AS n FROM clicks GROUP BY 1 HAVING count(*) >= 5), c AS (SELECT user_id, p_brand, count(*) AS n FROM clicks JOIN part ON article = p_partkey GROUP BY ALL) SELECT u.user_id, k.p_brand AS category, round((coalesce(c.n, 0) + 1)::DOUBLE / (u.n + (SELECT count(*) FROM k)), 6) AS frequency FROM u CROSS JOIN k LEFT JOIN c ON c.user_id = u.user_id AND c.p_brand = k.p_brand")
def f42(spark, d):
    from ..operators.statistics import laplace_frequency

    seen = clicks(spark, d).join(items(spark, d).select("article", "category"), "article").select("user_id", "category")
    all_values = items(spark, d).select("category").distinct()
    return laplace_frequency(seen, "user_id", "category", all_values, least=5).select("user_id", "category", R6("frequency").alias("frequency"))


@q("f43_bayes_ratio", "WITH e AS (SELECT user_id, event_type, isodow(ts)::INTEGER AS weekday, (hour(ts) // 4)::INTEGER AS hours FROM events), g AS (SELECT event_type, weekday, hours, count(*)::DOUBLE / (SELECT count(*) FROM e) AS p FROM e GROUP BY ALL), u AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1), c AS (SELECT user_id, event_type, weekday, hours, count(*) AS n FROM e GROUP BY ALL) SELECT user_id, event_type, weekday, hours, round((c.n::DOUBLE / u.n) / g.p, 6) AS ratio FROM c JOIN u USING (user_id) JOIN g USING (event_type, weekday, hours)")
def f43(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", T.iso_weekday("ts").alias("weekday"), T.hour_group("ts").alias("hours"))
    key = ["event_type", "weekday", "hours"]
    own = e.groupBy("user_id", *key).agg(F.count("*").alias("n"))
    users = own.groupBy("user_id").agg(F.sum("n").alias("total"))
    shape = own.groupBy(*key).agg(F.sum("n").alias("k"))
    every = shape.agg(F.sum("k").alias("every"))
    out = own.join(users, "user_id").join(shape, key).crossJoin(F.broadcast(every))
    return out.select("user_id", *key, R6((F.col("n") / F.col("total")) / (F.col("k") / F.col("every"))).alias("ratio"))


@q("f44_json_field", "SELECT event_id, (props->>'k')::INTEGER AS k FROM events")
def f44(spark, d):
    return table(spark, d, "events", "event_id", "props").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@q("f45_map_functions", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def f45(spark, d):
    counts = table(spark, d, "events", "event_type").groupBy("event_type").agg(F.count("*").alias("n"))
    pairs = counts.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return pairs.select(F.explode("m").alias("event_type", "n"))


@q("f46_duration_text", "SELECT o_orderkey, l_days || 'd ' || l_hours || 'h' AS lag FROM (SELECT o_orderkey, (h // 24)::VARCHAR AS l_days, (h % 24)::VARCHAR AS l_hours FROM (SELECT o_orderkey, date_sub('hour', TIMESTAMP '1995-01-01', o_orderdate) AS h FROM orders))")
def f46(spark, d):
    h = T.between("HOUR", F.lit("1995-01-01").cast("timestamp_ntz"), "o_orderdate")
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.format_string("%dd %dh", F.floor(h / 24), h % 24).alias("lag"))


@q("f39_power_transform")
def f39(spark, d):
    from ..operators.statistics import yeo_johnson

    return yeo_johnson(table(spark, d, "part", "p_partkey", "p_retailprice"), "p_retailprice", "scaled")


@q("f39_quantile_normal")
def f39b(spark, d):
    from ..operators.statistics import quantile_normal

    return quantile_normal(table(spark, d, "part", "p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", "scaled")
