"""Metrics (V)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import cosine_distance
from ..operators import metrics as M
from ..sources.tables import candidates, clicks, ctes, table, vectors
from .base import register as q

R6 = lambda c: F.round(c, 6)
CAND = ["impression_id", "article", "seller"]
G = ["impression_id"]
#: A score that repeats within impressions, so that ties matter.
SCORE = "floor(quantity / 10)"
PROB = "quantity / 51"


def _scored(spark, d):
    return candidates(spark, d).withColumns({"score": F.floor(F.col("quantity") / 10).cast("double"), "p": F.col("quantity") / 51})


_S = ctes("cand") + f", s AS (SELECT *, {SCORE}::DOUBLE AS score, {PROB} AS p FROM cand), k AS (SELECT impression_id FROM s GROUP BY 1 HAVING sum(target) BETWEEN 1 AND count(*) - 1)"


@q("v01_auc", _S + " SELECT a.impression_id, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM s a JOIN s b ON a.impression_id = b.impression_id AND a.target = 1 AND b.target = 0 GROUP BY 1")
def v01(spark, d):
    return M.auc(_scored(spark, d), G, "score", "target").withColumn("auc", R6("auc"))


@q("v01_mean_auc", _S + ", x AS (SELECT a.impression_id, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS auc FROM s a JOIN s b ON a.impression_id = b.impression_id AND a.target = 1 AND b.target = 0 GROUP BY 1) SELECT round(avg(auc), 6) AS auc, count(*) AS n FROM x")
def v01m(spark, d):
    return M.auc(_scored(spark, d), G, "score", "target").agg(R6(F.avg("auc")).alias("auc"), F.count("*").alias("n"))


@q("v02_weighted_auc", _S + " SELECT a.impression_id, round(sum(a.price * b.price * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) / sum(a.price * b.price), 6) AS auc FROM s a JOIN s b ON a.impression_id = b.impression_id AND a.target = 1 AND b.target = 0 GROUP BY 1")
def v02(spark, d):
    return M.weighted_auc(_scored(spark, d), G, "score", "target", "price").withColumn("auc", R6("auc"))


@q("v03_strict_auc", _S + " SELECT a.impression_id, round(avg((a.score > b.score)::INTEGER), 6) AS auc FROM s a JOIN s b ON a.impression_id = b.impression_id AND a.target = 1 AND b.target = 0 GROUP BY 1")
def v03(spark, d):
    return M.strict_auc(_scored(spark, d), G, "score", "target").withColumn("auc", R6("auc"))


_R = ctes("cand") + ", r AS (SELECT *, row_number() OVER (PARTITION BY impression_id ORDER BY price DESC, article, seller) AS rank, row_number() OVER (PARTITION BY impression_id ORDER BY target DESC, price DESC, article, seller) AS ideal FROM cand)"


def _ranked(spark, d):
    return M.ranked(candidates(spark, d), G, "price", ["article", "seller"])


@q("v04_mrr", _R + " SELECT impression_id, round(sum(target / rank) / nullif(sum(target), 0), 6) AS mrr FROM r GROUP BY 1")
def v04(spark, d):
    return M.mrr_all(_ranked(spark, d), G, "target").withColumn("mrr", R6("mrr"))


@q("v05_ndcg_5", _R + " SELECT impression_id, round(sum(CASE WHEN rank <= 5 THEN (pow(2.0, target) - 1) / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= 5 THEN (pow(2.0, target) - 1) / log2(ideal + 1) ELSE 0 END), 0), 6) AS ndcg FROM r GROUP BY 1")
def v05(spark, d):
    return M.ndcg(_ranked(spark, d), G, "target", 5).withColumn("ndcg", R6("ndcg"))


@q("v06_v07_metric_set", _S + " SELECT round(-avg(target * ln(p) + (1 - target) * ln(1 - p)), 6) AS logloss, round(sqrt(avg((p - target) * (p - target))), 6) AS rmse, round(avg(((p >= 0.5)::INTEGER = target)::INTEGER), 6) AS accuracy, round(2.0 * sum((p >= 0.5)::INTEGER * target) / (sum((p >= 0.5)::INTEGER) + sum(target)), 6) AS f1 FROM s")
def v06(spark, d):
    p, y = F.col("p"), F.col("target")
    return _scored(spark, d).agg(R6(M.log_loss(p, y)).alias("logloss"), R6(M.rmse(p, y)).alias("rmse"), R6(M.accuracy(p, y)).alias("accuracy"), R6(M.f1(p, y)).alias("f1"))


_SIM = "cand0 AS (SELECT l_orderkey AS g, l_partkey AS a FROM lineitem GROUP BY ALL), e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"


@q("v08_intralist_diversity", f"WITH {_SIM} SELECT x.g AS impression_id, round(avg(1 - list_cosine_similarity(p.v, r.v)), 6) AS diversity FROM cand0 x JOIN cand0 y ON x.g = y.g AND x.a < y.a JOIN e p ON p.vec_id = x.a JOIN e r ON r.vec_id = y.a GROUP BY 1")
def v08(spark, d):
    from ..operators.embeddings import pair_distances

    lists = candidates(spark, d).select("impression_id", "article").distinct()
    return pair_distances(lists, vectors(spark, d), "impression_id").groupBy("impression_id").agg(R6(F.avg("distance")).alias("diversity"))


@q("v09_serendipity", f"WITH {_SIM}, h AS (SELECT o_custkey AS u, l_partkey AS a FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY ALL), r AS (SELECT o_custkey AS u, l_partkey AS a FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'N' GROUP BY ALL) SELECT r.u AS user_id, round(avg(1 - list_cosine_similarity(x.v, y.v)), 6) AS serendipity FROM r JOIN h ON r.u = h.u JOIN e x ON x.vec_id = r.a JOIN e y ON y.vec_id = h.a GROUP BY 1")
def v09(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag").join(table(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    side = lambda flag: lines.where(F.col("l_returnflag") == flag).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("article")).distinct()
    v = vectors(spark, d).select("article", "vector")
    shown = side("N").join(v, "article").select("user_id", F.col("vector").alias("a"))
    read = side("R").join(v, "article").select("user_id", F.col("vector").alias("b"))
    return shown.join(read, "user_id").groupBy("user_id").agg(R6(F.avg(cosine_distance("a", "b"))).alias("serendipity"))


@q("v10_coverage", ctes("cand") + " SELECT count(DISTINCT article) AS covered, round(count(DISTINCT article)::DOUBLE / (SELECT count(*) FROM part), 6) AS share FROM cand WHERE target = 1 AND position = 1")
def v10(spark, d):
    covered = candidates(spark, d).where("target = 1 and position = 1").agg(F.count_distinct("article").alias("covered"))
    return covered.crossJoin(table(spark, d, "part", "p_partkey").agg(F.count("*").alias("n"))).select("covered", R6(F.col("covered") / F.col("n")).alias("share"))


_POP = ctes("clicks") + ", p AS (SELECT article, count(*)::DOUBLE / (SELECT count(DISTINCT user_id) FROM clicks) AS popularity FROM clicks GROUP BY 1)"


def _popularity(spark, d):
    c = clicks(spark, d)
    return c.groupBy("article").agg(F.count("*").alias("n")).crossJoin(F.broadcast(c.agg(F.count_distinct("user_id").alias("users")))).select("article", (F.col("n") / F.col("users")).alias("popularity"))


@q("v11_v18_novelty", _POP + " SELECT user_id, round(avg(-log2(popularity)), 6) AS novelty, round(avg(popularity), 6) AS popularity FROM clicks JOIN p USING (article) GROUP BY 1")
def v11(spark, d):
    return clicks(spark, d).join(_popularity(spark, d), "article").groupBy("user_id").agg(R6(F.avg(-F.log2("popularity"))).alias("novelty"), R6(F.avg("popularity")).alias("popularity"))


@q("v14_item_popularity", _POP + " SELECT article, round(popularity, 6) AS popularity FROM p")
def v14(spark, d):
    return _popularity(spark, d).select("article", R6("popularity").alias("popularity"))


_COUNTS = ctes("clicks") + ", c AS (SELECT p_partkey, count(article) AS n FROM part LEFT JOIN clicks ON article = p_partkey GROUP BY 1)"


def _counts(spark, d):
    n = clicks(spark, d).groupBy("article").agg(F.count("*").alias("n"))
    return table(spark, d, "part", "p_partkey").join(n, F.col("p_partkey") == F.col("article"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))


@q("v12_dispersion", _COUNTS + " SELECT round(count(*) * (pow(sum(n), 2) - sum(n * n)) / (pow(sum(n), 2) * (count(*) - 1)), 6) AS dispersion FROM c")
def v12(spark, d):
    return M.dispersion(_counts(spark, d)).select(R6(F.col("dispersion").cast("double")).alias("dispersion"))


@q("v13_distribution", "SELECT p_brand AS category, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (), 6) AS share FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def v13(spark, d):
    x = table(spark, d, "lineitem", "l_partkey", "l_quantity").join(table(spark, d, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("category")).agg(F.sum("l_quantity").alias("s"))
    return x.crossJoin(F.broadcast(x.agg(F.sum("s").alias("t")))).select("category", R6(F.col("s") / F.col("t")).alias("share"))


@q("v17_concentration", _COUNTS + ", r AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS k, sum(n) OVER () AS t FROM c) SELECT round(2 * sum(i * n) / (max(k) * max(t)) - (max(k) + 1) / max(k), 6) AS gini, round(1 - sum(pow(n / t, 2)), 6) AS herfindahl, round(-sum(CASE WHEN n > 0 THEN n / t * log2(n / t) ELSE 0 END), 6) AS shannon FROM r")
def v17(spark, d):
    return M.concentration(_counts(spark, d)).select(*(R6(F.col(c).cast("double")).alias(c) for c in ("gini", "herfindahl", "shannon")))


_REC = ctes("clicks") + ", pop AS (SELECT article, row_number() OVER (ORDER BY n DESC, article) AS rank FROM (SELECT article, count(*) AS n FROM clicks WHERE ts < TIMESTAMP '2000-01-01' GROUP BY 1) ORDER BY 2 LIMIT 50), truth AS (SELECT DISTINCT user_id AS u, article FROM clicks WHERE ts >= TIMESTAMP '2000-01-01'), h AS (SELECT t.u, pop.rank, (x.article IS NOT NULL)::INTEGER AS hit FROM (SELECT DISTINCT u FROM truth) t CROSS JOIN pop LEFT JOIN truth x ON x.u = t.u AND x.article = pop.article), s AS (SELECT *, sum(hit) OVER (PARTITION BY u ORDER BY rank) AS seen FROM h), n AS (SELECT u, count(*) AS n FROM truth GROUP BY 1)"


def _recommended(spark, d):
    c = clicks(spark, d)
    top = c.where("ts < '2000-01-01'").groupBy("article").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "article").limit(50)
    # A top list of 50 rows: numbering it in one task is bounded.
    top = top.select(F.col("article").alias("item"), F.row_number().over(W.orderBy(F.desc("n"), "article")).alias("rank"))
    truth = c.where("ts >= '2000-01-01'").select(F.col("user_id").alias("user"), F.col("article").alias("item")).distinct()
    return truth.select("user").distinct().crossJoin(F.broadcast(top)), truth


@q("v15_v20_top_k_metrics", _REC + " SELECT s.u AS user, round(sum(hit)::DOUBLE / count(*), 6) AS precision, round(sum(hit)::DOUBLE / any_value(n), 6) AS recall, round(sum(hit)::DOUBLE / least(count(*), any_value(n)), 6) AS precision_min_den, round(sum(hit * seen / rank) / any_value(n), 6) AS ap, round(coalesce(1.0 / min(CASE WHEN hit = 1 THEN rank END), 0), 6)::DOUBLE AS rr, round(sum(hit / log2(rank + 1)) / list_sum(list_transform(range(1, least(any_value(n), 50) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, max(hit)::INTEGER AS hit, round(sum(hit / rank), 6) AS arhr, round(coalesce(2.0 * (sum(hit)::DOUBLE / count(*)) * (sum(hit)::DOUBLE / any_value(n)) / nullif(sum(hit)::DOUBLE / count(*) + sum(hit)::DOUBLE / any_value(n), 0), 0), 6)::DOUBLE AS f1 FROM s JOIN n ON n.u = s.u GROUP BY 1")
def v15(spark, d):
    r = M.top_k_metrics(*_recommended(spark, d), 50)
    return r.select("user", *(c if c == "hit" else R6(c).alias(c) for c in r.columns[1:]))


@q("v16_user_coverage", _REC + " SELECT count(DISTINCT u) AS users, count(DISTINCT CASE WHEN hit = 1 THEN u END) AS users_hit, count(DISTINCT CASE WHEN hit = 1 THEN rank END) AS items_hit FROM s")
def v16(spark, d):
    got, truth = _recommended(spark, d)
    h = got.join(truth.withColumn("hit", F.lit(1)), ["user", "item"], "left")
    return h.agg(F.count_distinct("user").alias("users"), F.count_distinct(F.when(F.col("hit") == 1, F.col("user"))).alias("users_hit"), F.count_distinct(F.when(F.col("hit") == 1, F.col("rank"))).alias("items_hit"))


@q("v19_inter_list_diversity", ctes("cand") + ", l AS (SELECT DISTINCT impression_id AS g, article FROM cand), c AS (SELECT article, count(*) AS n FROM l GROUP BY 1), t AS (SELECT count(DISTINCT g)::DOUBLE AS lists, count(*)::DOUBLE / count(DISTINCT g) AS size FROM l) SELECT round(1 - (SELECT sum(n * (n - 1.0)) FROM c) / (lists * (lists - 1) * size), 6) AS diversity FROM t")
def v19(spark, d):
    l = candidates(spark, d).select("impression_id", "article").distinct()  # noqa: E741
    shared = l.groupBy("article").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1.0)).alias("s"))
    sizes = l.agg(F.count_distinct("impression_id").cast("double").alias("lists"), F.count("*").alias("rows"))
    x = shared.crossJoin(sizes)
    return x.select(R6(1 - F.col("s") / (F.col("lists") * (F.col("lists") - 1) * F.col("rows") / F.col("lists"))).alias("diversity"))


@q("v21_evaluator_pruning", ctes("clicks") + " SELECT user_id, count(*) AS n FROM clicks WHERE article % 10 <> 0 GROUP BY 1 HAVING count(*) >= 5")
def v21(spark, d):
    return clicks(spark, d).where("article % 10 <> 0").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 5")


@q("v22_candidate_novelty_range", _POP + ", x AS (SELECT DISTINCT o_orderkey AS g, l_partkey AS article FROM orders JOIN lineitem ON o_orderkey = l_orderkey), r AS (SELECT g, -log2(popularity) AS nov, row_number() OVER (PARTITION BY g ORDER BY popularity, p.article) AS lo, row_number() OVER (PARTITION BY g ORDER BY popularity DESC, p.article) AS hi FROM x JOIN p ON p.article = x.article) SELECT g AS impression_id, round(avg(nov) FILTER (WHERE lo <= 3), 6) AS most, round(avg(nov) FILTER (WHERE hi <= 3), 6) AS least FROM r GROUP BY 1")
def v22(spark, d):
    x = candidates(spark, d).select("impression_id", "article").distinct().join(_popularity(spark, d), "article")
    w = W.partitionBy("impression_id")
    nov = -F.log2("popularity")
    x = x.withColumns({"lo": F.row_number().over(w.orderBy("popularity", "article")), "hi": F.row_number().over(w.orderBy(F.desc("popularity"), "article"))})
    return x.groupBy("impression_id").agg(R6(F.avg(F.when(F.col("lo") <= 3, nov))).alias("most"), R6(F.avg(F.when(F.col("hi") <= 3, nov))).alias("least"))


@q("v23_binarise", _S + f" SELECT {', '.join(CAND)}, (p >= 0.5)::INTEGER AS said FROM s")
def v23(spark, d):
    return _scored(spark, d).select(*CAND, (F.col("p") >= 0.5).cast("int").alias("said"))
