"""Embedding operators (E) and sparse recommenders (R)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors as V
from ..operators import embeddings as E
from ..operators import recommenders as R
from ..operators.sampling import dense_index, draw, hash_split
from ..sources.tables import candidates, clicks, ctes, table, vectors
from .base import register as q

R6 = lambda c: F.round(c, 6)


def _urm(spark, d):
    """Implicit user by item matrix."""
    return clicks(spark, d).select(F.col("user_id").alias("row"), F.col("article").alias("col")).distinct().withColumn("value", F.lit(1.0))


_URM = ctes("clicks") + ", x AS (SELECT DISTINCT user_id AS row, article AS col, 1.0::DOUBLE AS value FROM clicks)"


def _quantities(spark, d):
    """Seller by size quantities: a dense-ish matrix."""
    lines = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity").join(table(spark, d, "part", "p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("l_suppkey").alias("row"), F.col("p_size").cast("long").alias("col")).agg(F.sum("l_quantity").alias("value"))


_QUANTITIES = "x AS (SELECT l_suppkey AS row, p_size::BIGINT AS col, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


@q("e01_mean_user_embedding", ctes("clicks", "vec") + ", l AS (SELECT user_id, generate_subscripts(vector, 1) - 1 AS pos, unnest(vector) AS x FROM clicks JOIN vec USING (article)) SELECT user_id, pos::INTEGER AS pos, round(avg(x), 6) + 0.0 AS x FROM l GROUP BY ALL")
def e01(spark, d):
    seen = clicks(spark, d).join(vectors(spark, d), "article")
    return E.mean_vector(seen, "user_id", "vector").select("user_id", F.posexplode("vector").alias("pos", "x")).withColumn("x", R6("x"))


@q("e02_user_item_distance", ctes("clicks", "vec") + ", l AS (SELECT user_id, generate_subscripts(vector, 1) AS pos, unnest(vector) AS x FROM clicks JOIN vec USING (article)), m AS (SELECT user_id, pos, avg(x) AS x FROM l GROUP BY ALL), u AS (SELECT user_id, list(x ORDER BY pos) AS v FROM m GROUP BY 1) SELECT u.user_id, vec.article, round(1 - list_cosine_similarity(u.v, vec.vector), 6) AS distance FROM u JOIN (SELECT DISTINCT user_id, article FROM clicks) c ON c.user_id = u.user_id JOIN vec ON vec.article = c.article")
def e02(spark, d):
    seen = clicks(spark, d).join(vectors(spark, d), "article")
    users = E.mean_vector(seen, "user_id", "vector", name="mean")
    return seen.select("user_id", "article", "vector").dropDuplicates(["user_id", "article"]).join(users, "user_id").select("user_id", "article", R6(V.cosine_distance("mean", "vector")).alias("distance"))


_HIST = ctes("clicks", "cand", "vec") + ", h AS (SELECT DISTINCT user_id, article FROM clicks), c AS (SELECT DISTINCT o_custkey AS user_id, article FROM cand JOIN orders ON impression_id = o_orderkey), p AS (SELECT c.user_id, c.article, list_cosine_similarity(a.vector, b.vector) AS s, list_dot_product(a.vector, b.vector) AS dp, h.article AS seen FROM c JOIN h ON c.user_id = h.user_id AND h.article <> c.article JOIN vec a ON a.article = c.article JOIN vec b ON b.article = h.article)"


def _pairs(spark, d):
    h = clicks(spark, d).select("user_id", F.col("article").alias("seen")).distinct()
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    c = candidates(spark, d).join(o, F.col("impression_id") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), "article").distinct()
    v = vectors(spark, d)
    return c.join(h, "user_id").where("article <> seen").join(v.select("article", F.col("vector").alias("a")), "article").join(v.select(F.col("article").alias("seen"), F.col("vector").alias("b")), "seen")


@q("e03_history_cosine_stats", _HIST + " SELECT user_id, article, round(avg(1 - s), 6) AS mean, round(min(1 - s), 6) AS low, round(max(1 - s), 6) AS high, round(stddev_samp(1 - s), 6) AS std FROM p GROUP BY ALL")
def e03(spark, d):
    x = _pairs(spark, d).withColumn("x", V.cosine_distance("a", "b"))
    return x.groupBy("user_id", "article").agg(R6(F.avg("x")).alias("mean"), R6(F.min("x")).alias("low"), R6(F.max("x")).alias("high"), R6(F.stddev_samp("x")).alias("std"))


def _weighted(name, weight, sql):
    @q(name, ctes("clicks", "vec") + f", c AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last_ts, max(quantity) OVER (PARTITION BY user_id) AS top FROM clicks JOIN vec USING (article)), w AS (SELECT *, {sql} AS w0 FROM c), n AS (SELECT *, w0 / nullif(sum(w0) OVER (PARTITION BY user_id), 0) AS w FROM w), l AS (SELECT user_id, w, generate_subscripts(vector, 1) - 1 AS pos, unnest(vector) AS x FROM n WHERE w IS NOT NULL) SELECT user_id, pos::INTEGER AS pos, round(avg(x * w), 6) + 0.0 AS x FROM l GROUP BY ALL")
    def run(spark, d):
        u = W.partitionBy("user_id")
        c = clicks(spark, d).join(vectors(spark, d), "article").withColumns({"last_ts": F.max("ts").over(u), "top": F.max("quantity").over(u)})
        c = c.withColumn("w0", weight()).withColumn("w", F.try_divide("w0", F.sum("w0").over(u))).where("w is not null")
        return E.mean_vector(c, "user_id", "vector", F.col("w")).select("user_id", F.posexplode("vector").alias("pos", "x")).withColumn("x", R6("x"))


_weighted("e04_time_decayed_embedding", lambda: F.exp(F.lit(-1e-15) * F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("last_ts"))), "exp(-1e-15 * (epoch_us(last_ts) - epoch_us(ts)))")
_weighted("e05_scroll_weighted_embedding", lambda: F.sqrt("quantity"), "sqrt(quantity)")
_weighted("e06_read_time_weighted_embedding", lambda: F.sqrt(F.col("top") - F.col("quantity")), "sqrt(top - quantity)")


@q("e07_unit_rows", "SELECT vec_id AS article, pos - 1 AS pos, round(x / (n + 1e-6), 6) + 0.0 AS x FROM (SELECT vec_id, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v))) AS n, generate_subscripts(embedding, 1)::INTEGER AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings)")
def e07(spark, d):
    return vectors(spark, d).select("article", F.posexplode(V.unit("vector")).alias("pos", "x")).withColumn("x", R6("x"))


@q("e08_e11_dot_aggregations", _HIST + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id, article ORDER BY seen DESC) AS rn FROM p) SELECT user_id, article, round(avg(dp), 6) AS mean, round(max(dp), 6) AS high, round(min(dp), 6) AS low, round(median(dp), 6) AS mid, round(avg(dp) FILTER (WHERE rn <= 3), 6) AS mean_tail FROM r GROUP BY ALL")
def e08(spark, d):
    x = _pairs(spark, d).withColumn("x", V.dot("a", "b")).withColumn("rn", F.row_number().over(W.partitionBy("user_id", "article").orderBy(F.desc("seen"))))
    return x.groupBy("user_id", "article").agg(R6(F.avg("x")).alias("mean"), R6(F.max("x")).alias("high"), R6(F.min("x")).alias("low"), R6(F.median("x")).alias("mid"), R6(F.avg(F.when(F.col("rn") <= 3, F.col("x")))).alias("mean_tail"))


@q("e09_e10_weighted_scores", ctes("clicks") + ", w AS (SELECT user_id, article, impression_id, seller, price, sqrt(quantity) AS a, (quantity - min(quantity) OVER u) / nullif(max(quantity) OVER u - min(quantity) OVER u, 0) AS b, 1 / (sqrt(date_sub('hour', ts, max(ts) OVER u)) + 1) AS c FROM clicks WINDOW u AS (PARTITION BY user_id)) SELECT user_id, impression_id, article, seller, round(price * 0.7390851 * a / sum(a) OVER (PARTITION BY user_id), 4) AS a, round(price * 0.7390851 * b / nullif(sum(b) OVER (PARTITION BY user_id), 0), 4) AS b, round(price * 0.7390851 * c / sum(c) OVER (PARTITION BY user_id), 4) AS c FROM w")
def e09(spark, d):
    u = W.partitionBy("user_id")
    low, high = F.min("quantity").over(u), F.max("quantity").over(u)
    w = clicks(spark, d).withColumns({"a": F.sqrt("quantity"), "b": F.try_divide(F.col("quantity") - low, high - low), "c": 1 / (F.sqrt(F.timestamp_diff("HOUR", F.col("ts"), F.max("ts").over(u))) + 1)})
    return w.select("user_id", "impression_id", "article", "seller", *(F.round(F.try_divide(F.col("price") * 0.7390851 * F.col(k), F.sum(k).over(u)), 4).alias(k) for k in "abc"))


@q("e12_merged_distances", _HIST + ", s AS (SELECT user_id, article, avg(s) AS c, avg(dp) AS dp FROM p GROUP BY ALL), m AS (SELECT *, (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS a, (dp - min(dp) OVER ()) / (max(dp) OVER () - min(dp) OVER ()) AS b FROM s) SELECT user_id, article, round((a + b) / 2, 6) AS mean, round(least(a, b), 6) AS low, round(greatest(a, b), 6) AS high FROM m")
def e12(spark, d):
    s = _pairs(spark, d).groupBy("user_id", "article").agg(F.avg(V.cosine("a", "b")).alias("c"), F.avg(V.dot("a", "b")).alias("dp"))
    ends = s.agg(*(f(k).alias(f"{n}_{k}") for k in ("c", "dp") for n, f in (("lo", F.min), ("hi", F.max))))
    a, b = ((F.col(k) - F.col(f"lo_{k}")) / (F.col(f"hi_{k}") - F.col(f"lo_{k}")) for k in ("c", "dp"))
    return s.crossJoin(F.broadcast(ends)).select("user_id", "article", R6((a + b) / 2).alias("mean"), R6(F.least(a, b)).alias("low"), R6(F.greatest(a, b)).alias("high"))


@q("e14_attach_embeddings", "SELECT p_partkey, vec_id IS NOT NULL AS known, len(embedding) AS width FROM part LEFT JOIN embeddings ON p_partkey = vec_id")
def e14(spark, d):
    v = vectors(spark, d).select("article", "vector")
    return table(spark, d, "part", "p_partkey").join(v, F.col("p_partkey") == F.col("article"), "left").select("p_partkey", F.col("article").isNotNull().alias("known"), F.size("vector").cast("long").alias("width"))


@q("r01_id_mappings", ctes("clicks") + " SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS row_id FROM (SELECT DISTINCT user_id FROM clicks)")
def r01(spark, d):
    return dense_index(clicks(spark, d).select("user_id").distinct(), ["user_id"], "row_id").select("user_id", "row_id")


@q("r02_r28_r37_implicit_urm", _URM + " SELECT * FROM x")
def r02(spark, d):
    return _urm(spark, d)


@q("r03_topic_urm", ctes("clicks", "items") + " SELECT DISTINCT user_id, topic FROM (SELECT user_id, unnest(topics) AS topic FROM clicks JOIN items USING (article))")
def r03(spark, d):
    from ..sources.tables import items

    return clicks(spark, d).join(items(spark, d).select("article", "topics"), "article").select("user_id", F.explode("topics").alias("topic")).distinct()


@q("r04_r32_matrix_statistics", _URM + ", u AS (SELECT row, count(*) AS n FROM x GROUP BY 1) SELECT round(1 - (SELECT count(*) FROM x)::DOUBLE / ((SELECT count(DISTINCT row) FROM x) * (SELECT count(DISTINCT col) FROM x)), 6) AS sparsity, (SELECT max(n) FROM u) AS longest, (SELECT round(avg(n), 6) FROM u) AS mean")
def r04(spark, d):
    x = _urm(spark, d)
    s = x.agg(F.count("*").alias("n"), F.count_distinct("row").alias("r"), F.count_distinct("col").alias("c"))
    u = x.groupBy("row").agg(F.count("*").alias("n")).agg(F.max("n").alias("longest"), F.avg("n").alias("mean"))
    return s.crossJoin(u).select(R6(1 - F.col("n") / (F.col("r") * F.col("c"))).alias("sparsity"), "longest", R6("mean").alias("mean"))


@q("r05_icm_from_embedding", "SELECT vec_id AS row, (generate_subscripts(embedding, 1) - 1)::INTEGER AS col, round(unnest(embedding)::DOUBLE, 6) + 0.0 AS value FROM embeddings")
def r05(spark, d):
    return vectors(spark, d).select(F.col("article").alias("row"), F.posexplode("vector").alias("col", "value")).withColumn("value", R6("value"))


_GRAM = ", n AS (SELECT col, sum(value * value) AS q FROM y GROUP BY 1), g AS (SELECT a.col AS i, b.col AS j, sum(a.value * b.value) AS dot FROM y a JOIN y b ON a.row = b.row AND a.col <> b.col GROUP BY ALL), s AS (SELECT i, j, {formula} AS v FROM g JOIN n ni ON ni.col = i JOIN n nj ON nj.col = j), t AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY v DESC, i) AS rn FROM s WHERE v <> 0) SELECT i, j, round(v, 6) AS value FROM t WHERE rn <= 5"
_PLAIN = ", y AS (SELECT * FROM x)"
_SIMS = {
    "cosine": ({"shrink": 10.0}, _PLAIN, "dot / (sqrt(ni.q) * sqrt(nj.q) + 10 + 1e-6)"),
    "adjusted": ({}, ", y AS (SELECT row, col, value - avg(value) OVER (PARTITION BY row) AS value FROM x)", "dot / (sqrt(ni.q) * sqrt(nj.q) + 1e-6)"),
    "pearson": ({}, ", y AS (SELECT row, col, value - avg(value) OVER (PARTITION BY col) AS value FROM x)", "dot / (sqrt(ni.q) * sqrt(nj.q) + 1e-6)"),
    "asymmetric": ({"alpha": 0.3}, _PLAIN, "dot / (pow(ni.q, 0.3) * pow(nj.q, 0.7) + 1e-6)"),
    "jaccard": ({}, ", y AS (SELECT row, col, 1.0 AS value FROM x WHERE value > 300)", "dot / (ni.q + nj.q - dot + 1e-6)"),
    "dice": ({}, ", y AS (SELECT row, col, 1.0 AS value FROM x WHERE value > 300)", "2 * dot / (ni.q + nj.q + 1e-6)"),
    "tversky": ({"a": 0.4, "b": 1.2}, ", y AS (SELECT row, col, 1.0 AS value FROM x WHERE value > 300)", "dot / (dot + (ni.q - dot) * 0.4 + (nj.q - dot) * 1.2 + 1e-6)"),
}


def _similarity(kind, extra):
    def run(spark, d):
        x = _quantities(spark, d)
        if kind in ("jaccard", "dice", "tversky"):
            x = x.where("value > 300").withColumn("value", F.lit(1.0))
        return R.similarity(x, kind, k=5, **extra).select("i", "j", R6("value").alias("value"))

    return run


for _kind, (_extra, _from, _formula) in _SIMS.items():
    q(f"r06_r07_similarity_{_kind}", "WITH " + _QUANTITIES + _from + _GRAM.replace("{formula}", _formula))(_similarity(_kind, _extra))


@q("r08_euclidean", "WITH " + _QUANTITIES + ", n AS (SELECT col, sum(value * value) AS q FROM x GROUP BY 1), g AS (SELECT a.col AS i, b.col AS j, sum(a.value * b.value) AS dot FROM x a JOIN x b ON a.row = b.row GROUP BY ALL), s AS (SELECT ni.col AS i, nj.col AS j, 1 / (ln(1 + sqrt(greatest(ni.q + nj.q - 2 * coalesce(dot, 0), 0))) + 1e-9) AS v FROM n ni JOIN n nj ON ni.col <> nj.col LEFT JOIN g ON g.i = ni.col AND g.j = nj.col), t AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY v DESC, i) AS rn FROM s) SELECT i, j, round(v, 6) AS value FROM t WHERE rn <= 5")
def r08(spark, d):
    return R.euclidean(_quantities(spark, d), 5, "log").select("i", "j", R6("value").alias("value"))


_CF = _URM + ", y AS (SELECT * FROM x), n AS (SELECT col, sum(value) AS q FROM y GROUP BY 1), g AS (SELECT a.col AS i, b.col AS j, sum(a.value * b.value) AS dot FROM y a JOIN y b ON a.row = b.row AND a.col <> b.col GROUP BY ALL), s AS (SELECT i, j, dot / (sqrt(ni.q) * sqrt(nj.q) + 5 + 1e-6) AS v FROM g JOIN n ni ON ni.col = i JOIN n nj ON nj.col = j), w AS (SELECT i, j, v FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY round(v, 9) DESC, i) AS rn FROM s) WHERE rn <= 20)"


def _item_knn(spark, d):
    y = _urm(spark, d)
    s = R.similarity(y, "cosine", shrink=5.0, k=1_000_000).withColumn("order", F.round("value", 9))
    from ..operators.sparse import top_per

    return y, top_per(s, "j", "order", ["i"], 20).drop("order")


@q("r10_r25_item_knn_scores", _CF + " SELECT y.row AS user_id, w.j AS article, round(sum(w.v), 6) AS score FROM y JOIN w ON y.col = w.i GROUP BY ALL")
def r10(spark, d):
    y, w = _item_knn(spark, d)
    return R.score(y, w).select(F.col("row").alias("user_id"), F.col("col").alias("article"), R6("value").alias("score"))


@q("r25_candidate_scores", _CF + ", c AS (SELECT DISTINCT o_custkey AS row, l_partkey AS col FROM orders JOIN lineitem ON o_orderkey = l_orderkey), z AS (SELECT y.row, w.j AS col, sum(w.v) AS v FROM y JOIN w ON y.col = w.i GROUP BY ALL) SELECT c.row AS user_id, c.col AS article, round(coalesce(v, 0), 6) AS score FROM c LEFT JOIN z ON z.row = c.row AND z.col = c.col")
def r25(spark, d):
    y, w = _item_knn(spark, d)
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    c = candidates(spark, d).join(o, F.col("impression_id") == F.col("o_orderkey")).select(F.col("o_custkey").alias("row"), F.col("article").alias("col")).distinct()
    return R.score(y.join(c.select("row").distinct(), "row", "left_semi"), w, c).select(F.col("row").alias("user_id"), F.col("col").alias("article"), R6("value").alias("score"))


@q("r10_r36_user_knn", _URM + ", y AS (SELECT col AS row, row AS col, value FROM x)" + _GRAM.replace("{formula}", "round(dot / (sqrt(ni.q) * sqrt(nj.q) + 1e-6), 9)"))
def r10u(spark, d):
    from ..operators.sparse import top_per, transpose

    s = R.similarity(transpose(_urm(spark, d)), "cosine", k=1_000_000).withColumn("value", F.round("value", 9))
    return top_per(s, "j", "value", ["i"], 5).select("i", "j", R6("value").alias("value"))


@q("r11_r27_content_knn", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-6) AS v FROM e a JOIN e b ON a.vec_id <> b.vec_id AND b.vec_id % 100 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY v DESC, i) AS rn FROM s) SELECT i, j, round(v, 6) AS value FROM t WHERE rn <= 5")
def r11(spark, d):
    # Each item whose id is divisible by 100, ranked against all items.
    return R.dense_knn(vectors(spark, d), F.col("article") % 100 == 0, 5).select("i", "j", R6("value").alias("value"))


@q("r12_hybrid_similarity", "WITH " + _QUANTITIES + ", a AS (SELECT row, col, value FROM x), u AS (SELECT i, j, sum(v) AS v FROM (SELECT p.col AS i, r.col AS j, 0.7 * sum(p.value * r.value) AS v FROM a p JOIN a r ON p.row = r.row AND p.col <> r.col GROUP BY ALL UNION ALL SELECT p.col, r.col, 0.3 * count(*) FROM a p JOIN a r ON p.row = r.row AND p.col <> r.col GROUP BY ALL) GROUP BY ALL) SELECT i, j, round(v, 6) AS value FROM u")
def r12(spark, d):
    g = R.gram(_quantities(spark, d))
    a, b = g.select("i", "j", (0.7 * F.col("dot")).alias("value")), g.select("i", "j", (0.3 * F.col("common")).alias("value"))
    return a.unionByName(b).groupBy("i", "j").agg(R6(F.sum("value")).alias("value"))


@q("r13_bm25", "WITH " + _QUANTITIES + ", n AS (SELECT count(DISTINCT row) AS n, sum(value) AS t FROM x), l AS (SELECT row, sum(value) AS l FROM x GROUP BY 1), f AS (SELECT col, count(*) AS df FROM x GROUP BY 1) SELECT x.row, x.col, round(ln(n::DOUBLE / (1 + df)) * value * 2.2 / (1.2 * (0.25 + 0.75 * l / (t / n)) + value), 6) AS value FROM x JOIN l ON l.row = x.row JOIN f ON f.col = x.col, n")
def r13(spark, d):
    return R.bm25(_quantities(spark, d)).withColumn("value", R6("value"))


@q("r13_tf_idf", "WITH " + _QUANTITIES + ", n AS (SELECT count(DISTINCT row) AS n FROM x), f AS (SELECT col, count(*) AS df FROM x GROUP BY 1) SELECT x.row, x.col, round(sqrt(value) * ln(n::DOUBLE / (1 + df)), 6) AS value FROM x JOIN f ON f.col = x.col, n")
def r13b(spark, d):
    return R.tf_idf(_quantities(spark, d)).withColumn("value", R6("value"))


def _walk(beta):
    by = f" / pow(d, {beta})" if beta else ""
    return "WITH " + _QUANTITIES + f", o AS (SELECT row, col FROM x WHERE value > 300), pu AS (SELECT row, col, 1.0 / count(*) OVER (PARTITION BY row) AS p FROM o), pi AS (SELECT row, col, 1.0 / count(*) OVER (PARTITION BY col) AS p FROM o), d AS (SELECT col, count(*)::DOUBLE AS d FROM o GROUP BY 1), w AS (SELECT pi.col AS i, pu.col AS j, sum(pi.p * pu.p){by.replace('d,', 'any_value(d.d),')} AS v FROM pi JOIN pu ON pi.row = pu.row AND pi.col <> pu.col JOIN d ON d.col = pu.col GROUP BY pi.col, pu.col), t AS (SELECT i, j, v / sum(v) OVER (PARTITION BY i) AS v FROM w) SELECT i, j, round(v, 6) AS value FROM t"


@q("r14_p3alpha", _walk(0))
def r14(spark, d):
    return R.p3alpha(_quantities(spark, d).where("value > 300"), k=1000).withColumn("value", R6("value"))


@q("r15_rp3beta", _walk(0.6))
def r15(spark, d):
    return R.p3alpha(_quantities(spark, d).where("value > 300"), beta=0.6, k=1000).withColumn("value", R6("value"))


@q("r16_ease_r")
def r16(spark, d):
    return R.easer(spark, _quantities(spark, d), penalty=100.0, k=10)


@q("r17_pure_svd")
def r17(spark, d):
    x = _quantities(spark, d)
    return R.svd_scores(x, R.pure_svd(spark, x, 8))


@q("r18_implicit_als")
def r18(spark, d):
    from ..operators.models import als_scores

    return als_scores(_urm(spark, d), rank=8, implicit=True)


@q("r19_nonnegative_factors")
def r19(spark, d):
    from ..operators.models import als_scores

    return als_scores(_quantities(spark, d), rank=6, implicit=False)


@q("r20_bpr_factors")
def r20(spark, d):
    from ..operators.models import bpr_scores

    return bpr_scores(_urm(spark, d), rank=8, epochs=2, seed=7)


@q("r21_slim")
def r21(spark, d):
    return R.slim(_quantities(spark, d).where("value > 300").withColumn("value", F.lit(1.0)), l1=0.5, l2=1.0, k=10)


@q("r22_top_pop", _URM + " SELECT col AS article, count(*) AS n, rank() OVER (ORDER BY count(*) DESC)::INTEGER AS rank FROM x GROUP BY 1")
def r22(spark, d):
    n = _urm(spark, d).groupBy(F.col("col").alias("article")).agg(F.count("*").alias("n"))
    # Ranks over distinct counts only: few rows whatever the catalogue.
    levels = n.groupBy("n").agg(F.count("*").alias("k")).withColumn("rank", (F.coalesce(F.sum("k").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1).cast("int"))
    return n.join(levels.drop("k"), "n").select("article", "n", "rank")


@q("r22_global_effects", "WITH " + _QUANTITIES + ", m AS (SELECT avg(value) AS m FROM x), i AS (SELECT col, sum(value - m) / (count(*) + 25) AS b FROM x, m GROUP BY 1), u AS (SELECT row, sum(value - m - b) / (count(*) + 10) AS c FROM x JOIN i ON i.col = x.col, m GROUP BY 1) SELECT x.row, x.col, round(m + b + c, 6) AS value FROM x JOIN i ON i.col = x.col JOIN u ON u.row = x.row, m")
def r22b(spark, d):
    x = _quantities(spark, d)
    mean, items, users = R.global_effects(x)
    return x.select("row", "col").join(items, "col").join(users, "row").crossJoin(F.broadcast(mean)).select("row", "col", R6(F.col("mean") + F.col("item_bias") + F.col("user_bias")).alias("value"))


@q("r26_topic_scores", ctes("clicks", "items") + ", t AS (SELECT user_id, topic, count(*) AS n FROM (SELECT user_id, unnest(topics) AS topic FROM clicks JOIN items USING (article)) GROUP BY ALL), c AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS article FROM orders JOIN lineitem ON o_orderkey = l_orderkey), e AS (SELECT user_id, article, unnest(topics) AS topic FROM c JOIN items USING (article)) SELECT e.user_id, article, sum(coalesce(n, 0))::BIGINT AS total, max(coalesce(n, 0)) AS high, round(avg(coalesce(n, 0)), 6) AS mean FROM e LEFT JOIN t ON t.user_id = e.user_id AND t.topic = e.topic GROUP BY ALL")
def r26(spark, d):
    from ..sources.tables import items

    topics = items(spark, d).select("article", F.explode("topics").alias("topic"))
    t = clicks(spark, d).select("user_id", "article").join(topics, "article").groupBy("user_id", "topic").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    c = candidates(spark, d).join(o, F.col("impression_id") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), "article").distinct()
    n = F.coalesce("n", F.lit(0))
    return c.join(topics, "article").join(t, ["user_id", "topic"], "left").groupBy("user_id", "article").agg(F.sum(n).alias("total"), F.max(n).alias("high"), R6(F.avg(n)).alias("mean"))


@q("r29_icm_pruning", "WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS topic FROM part), n AS (SELECT topic, count(DISTINCT p_partkey) AS n FROM t GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 20 AND count(DISTINCT p_partkey) <= 0.2 * (SELECT count(*) FROM part)) SELECT DISTINCT p_partkey, topic FROM t JOIN n USING (topic)")
def r29(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_name")
    t = p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("topic")).distinct()
    n = t.groupBy("topic").agg(F.count("*").alias("n")).crossJoin(F.broadcast(p.agg(F.count("*").alias("all")))).where("n >= 20 and n <= 0.2 * all").select("topic")
    return t.join(n, "topic", "left_semi").select("p_partkey", "topic")


def _core(rounds):
    out, last = _URM.replace(", x AS", ", x0 AS") + "", "x0"
    for i in range(1, rounds + 1):
        out += f", r{i} AS (SELECT * FROM {last} WHERE row IN (SELECT row FROM {last} GROUP BY row HAVING count(*) >= 7)), x{i} AS (SELECT * FROM r{i} WHERE col IN (SELECT col FROM r{i} GROUP BY col HAVING count(*) >= 7))"
        last = f"x{i}"
    return out + f" SELECT row, col FROM {last}"


@q("r30_k_core", _core(12))
def r30(spark, d):
    from ..sources.cuts import written

    return R.k_core(_urm(spark, d), 7, written).select("row", "col")


@q("r31_compact_indices", _URM + ", y AS (SELECT * FROM x WHERE col % 7 = 0) SELECT dense_rank() OVER (ORDER BY row) - 1 AS r, dense_rank() OVER (ORDER BY col) - 1 AS c FROM y")
def r31(spark, d):
    y = _urm(spark, d).where("col % 7 = 0")
    rows, cols = dense_index(y.select("row").distinct(), ["row"], "r"), dense_index(y.select("col").distinct(), ["col"], "c")
    return y.join(rows, "row").join(cols, "col").select("r", "c")


@q("r33_leave_last_out", ctes("clicks") + " SELECT user_id, impression_id, article, seller FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, impression_id DESC, article DESC, seller DESC) AS rn FROM clicks) WHERE rn <= 2")
def r33(spark, d):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("impression_id"), F.desc("article"), F.desc("seller"))
    return clicks(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("user_id", "impression_id", "article", "seller")


@q("r33_random_holdout", ctes("clicks") + " SELECT user_id, article, ('0x' || substr(md5(concat_ws(':', article, 7)), 1, 8))::BIGINT < 3435973836 AS train FROM clicks")
def r33b(spark, d):
    return hash_split(clicks(spark, d).select("user_id", "article"), "article", 0.8, 7)


_ROW = ["user_id", "impression_id", "article", "seller", "quantity"]
_RANKED = ctes("clicks") + f", r AS (SELECT {', '.join(_ROW)}, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws(':', impression_id, article, seller, quantity, 7)), impression_id, article, seller, quantity) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS rows FROM clicks)"


def _ranked(spark, d):
    """Each user's rows in random order; a user is few rows, so the draw orders them in one window."""
    w = W.partitionBy("user_id")
    rows = clicks(spark, d).select(*_ROW).withColumn("quantity", F.col("quantity").cast("long"))
    return rows.withColumns({"place": F.row_number().over(w.orderBy(draw("impression_id", "article", "seller", "quantity", seed=7), *_ROW[1:])) - 1, "rows": F.count("*").over(w)})


@q("r33_user_wise_split", _RANKED.replace("quantity", "quantity::BIGINT").replace("AS quantity::BIGINT", "AS quantity") + " SELECT user_id, impression_id, article, seller, place < floor(0.8::DOUBLE * rows) AS train FROM r")
def r33c(spark, d):
    return _ranked(spark, d).select(*_ROW[:4], (F.col("place") < F.floor(0.8 * F.col("rows"))).alias("train"))


@q("r33_leave_random_out", _RANKED.replace("quantity", "quantity::BIGINT").replace("AS quantity::BIGINT", "AS quantity") + " SELECT user_id, impression_id, article, seller FROM r WHERE place < 2")
def r33d(spark, d):
    return _ranked(spark, d).where("place < 2").select(*_ROW[:4])


@q("r33_cold_items", _URM + ", i AS (SELECT col, ('0x' || substr(md5(concat_ws(':', col, 11)), 1, 8))::BIGINT >= 3435973836 AS cold FROM (SELECT DISTINCT col FROM x)) SELECT cold, count(*) AS cells, count(DISTINCT row) AS rows, count(DISTINCT x.col) AS cols FROM x JOIN i ON i.col = x.col GROUP BY 1")
def r33e(spark, d):
    """Items that training never sees: all their cells are test."""
    s = hash_split(_urm(spark, d), "col", 0.8, 11).withColumn("cold", ~F.col("train"))
    return s.groupBy("cold").agg(F.count("*").alias("cells"), F.count_distinct("row").alias("rows"), F.count_distinct("col").alias("cols"))


_FOLD = "(ascii(md5(o_custkey::VARCHAR)) % 5)"


@q("r34_group_k_fold", f"SELECT o_orderkey, o_custkey, {_FOLD}::INTEGER AS fold, count(*) OVER (PARTITION BY {_FOLD}) AS fold_size FROM orders")
def r34(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey").withColumn("fold", F.ascii(F.md5(F.col("o_custkey").cast("string").cast("binary"))) % 5)
    return o.join(F.broadcast(o.groupBy("fold").agg(F.count("*").alias("fold_size"))), "fold")


@q("r35_factor_scores", "SELECT a.vec_id AS row, b.vec_id AS col, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % 500")
def r35(spark, d):
    v = vectors(spark, d)
    pairs = v.select(F.col("article").alias("row"), ((F.col("article") * 7 + 3) % 500).alias("col"))
    return R.factor_scores(pairs, v.select(F.col("article").alias("row"), "vector"), v.select(F.col("article").alias("col"), "vector")).withColumn("value", R6("value"))


@q("r39_split_disjoint", _URM + ", s AS (SELECT *, ascii(md5(row::VARCHAR)) % 5 < 4 AS train FROM x) SELECT count(*) FILTER (WHERE train) AS train, count(*) FILTER (WHERE NOT train) AS test, count(DISTINCT row) FILTER (WHERE train) AS train_rows, count(DISTINCT row) FILTER (WHERE NOT train) AS test_rows, (SELECT count(*) FROM (SELECT col FROM s WHERE train INTERSECT SELECT col FROM s WHERE NOT train)) AS shared_cols, (SELECT count(*) FROM (SELECT row, col FROM s WHERE train INTERSECT SELECT row, col FROM s WHERE NOT train)) AS shared FROM s")
def r39(spark, d):
    s = _urm(spark, d).withColumn("train", F.ascii(F.md5(F.col("row").cast("string").cast("binary"))) % 5 < 4)
    a, b = s.where("train"), s.where("not train")
    sizes = a.agg(F.count("*").alias("train"), F.count_distinct("row").alias("train_rows")).crossJoin(b.agg(F.count("*").alias("test"), F.count_distinct("row").alias("test_rows")))
    both = lambda *c: a.select(*c).intersect(b.select(*c)).agg(F.count("*").alias("shared" if len(c) == 2 else "shared_cols"))
    return sizes.crossJoin(both("col")).crossJoin(both("row", "col"))
