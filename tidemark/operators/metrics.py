"""Ranking, classification and beyond-accuracy metrics as aggregates over long frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def auc(df: DataFrame, by: list[str], score: str, label: str, name: str = "auc") -> DataFrame:
    """V1: per group by average ranks: (sum of positives' ranks - P(P+1)/2) / (P N); groups of one class are left out."""
    w = W.partitionBy(*by)
    rank = F.rank().over(w.orderBy(score)) + (F.count("*").over(W.partitionBy(*by, score)) - 1) / 2
    r = df.withColumn("__r", rank).groupBy(*by).agg(F.sum(F.when(F.col(label) == 1, F.col("__r"))).alias("__s"), F.sum(label).alias("__p"), F.count("*").alias("__n"))
    p, n = F.col("__p"), F.col("__n") - F.col("__p")
    return r.where((p > 0) & (n > 0)).select(*by, ((F.col("__s") - p * (p + 1) / 2) / (p * n)).alias(name))


def _pairs(levels: DataFrame, by: list[str], score: str, ties: float, name: str) -> DataFrame:
    """From positive and negative weight at each score: the weight of ordered pairs over that of all."""
    below = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    s = levels.withColumn("__w", F.col("__p") * (below + F.col("__n") * ties)).groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("__w", "__p", "__n")))
    return s.where("__p > 0 and __n > 0").select(*by, (F.col("__w") / (F.col("__p") * F.col("__n"))).alias(name))


def weighted_auc(df: DataFrame, by: list[str], score: str, label: str, weight: str, name: str = "auc") -> DataFrame:
    """V2: weight of (positive above negative) pairs, ties half, over the product of weights; by cumulative sums over distinct scores."""
    side = lambda k: F.sum(F.when(F.col(label) == k, F.col(weight)).otherwise(0.0))
    return _pairs(df.groupBy(*by, score).agg(side(1).alias("__p"), side(0).alias("__n")), by, score, 0.5, name)


def strict_auc(df: DataFrame, by: list[str], score: str, label: str, name: str = "auc") -> DataFrame:
    """V3: only strictly ordered pairs count."""
    return _pairs(df.groupBy(*by, score).agg(F.sum(label).alias("__p"), F.sum(1 - F.col(label)).alias("__n")), by, score, 0.0, name)


def ranked(df: DataFrame, by: list[str], score: str, ties: list[str], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), *ties)))


def mrr_all(df: DataFrame, by: list[str], label: str, rank: str = "rank", name: str = "mrr") -> DataFrame:
    """V4: mean reciprocal rank of all positives of a group."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(label) / F.col(rank)), F.sum(label)).alias(name))


def dcg(gain: Column, rank: Column, k: int) -> Column:
    return F.sum(F.when(rank <= k, (F.pow(F.lit(2.0), gain) - 1) / F.log2(rank + 1)).otherwise(0.0))


def ndcg(df: DataFrame, by: list[str], label: str, k: int, rank: str = "rank", name: str = "ndcg") -> DataFrame:
    """V5: null without positives."""
    ideal = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(label), rank))
    x = df.withColumn("__ideal", ideal)
    return x.groupBy(*by).agg(F.try_divide(dcg(F.col(label), F.col(rank), k), dcg(F.col(label), F.col("__ideal"), k)).alias(name))


def log_loss(p: Column, y: Column, eps: float = 1e-15) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return -F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def rmse(p: Column, y: Column) -> Column:
    return F.sqrt(F.avg((p - y) * (p - y)))


def accuracy(p: Column, y: Column, threshold: float = 0.5) -> Column:
    return F.avg(((p >= threshold).cast("int") == y).cast("double"))


def f1(p: Column, y: Column, threshold: float = 0.5) -> Column:
    hit, said = (p >= threshold).cast("int") * y, (p >= threshold).cast("int")
    return F.coalesce(F.try_divide(2.0 * F.sum(hit), F.sum(said) + F.sum(y)), F.lit(0.0))


def top_k_metrics(recommended: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per user from (user, item, rank) and (user, item): precision, recall, average precision, reciprocal rank, nDCG, hit, ARHR at k.

    Users with relevant items and no recommendation get zeros.
    """
    got = recommended.where(F.col("rank") <= k)
    truth = relevant.select("user", "item").distinct()
    positives = truth.groupBy("user").agg(F.count("*").alias("n_relevant"))
    hits = got.join(truth.withColumn("hit", F.lit(1)), ["user", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    hits = hits.withColumn("seen", F.sum("hit").over(W.partitionBy("user").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    per = hits.groupBy("user").agg(
        F.sum("hit").alias("hits"), F.count("*").alias("n"), F.sum(F.col("hit") * F.col("seen") / F.col("rank")).alias("ap"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.col("hit") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("hit") / F.col("rank")).alias("arhr"),
    )
    out = positives.join(per, "user", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    precision, recall = z(F.try_divide("hits", "n")), z(F.col("hits") / F.col("n_relevant"))
    return out.select(
        "user", precision.alias("precision"), recall.alias("recall"), z(F.try_divide("hits", F.least("n", "n_relevant"))).alias("precision_min_den"), z(F.col("ap") / F.col("n_relevant")).alias("ap"),
        z(F.try_divide(F.lit(1.0), F.col("first"))).alias("rr"), z(F.col("dcg") / best).alias("ndcg"), (z(F.col("hits").cast("double")) > 0).cast("int").alias("hit"), z(F.col("arhr")).alias("arhr"),
        z(F.try_divide(2 * precision * recall, precision + recall)).alias("f1"),
    )


def concentration(counts: DataFrame, count: str = "n") -> DataFrame:
    """Gini, Herfindahl and Shannon (bits) diversity of recommendation counts, items with none included.

    Gini needs ranks over all items: counts repeat a lot, so ranks come from a frame of distinct counts, not of items.
    """
    levels = counts.groupBy(F.col(count).alias("c")).agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.orderBy("c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    levels = levels.withColumn("first", before + 1)
    k, c, first = F.col("k"), F.col("c"), F.col("first")
    ranks = k * first + k * (k - 1) / 2
    s = levels.agg(F.sum(k).alias("n"), F.sum(k * c).alias("total"), F.sum(c * ranks).alias("weighted"), F.sum(k * c * c).alias("square"), F.sum(F.when(c > 0, k * c * F.log2(c)).otherwise(0.0)).alias("bits"))
    n, total = F.col("n"), F.col("total")
    return s.select((2 * F.col("weighted") / (n * total) - (n + 1) / n).alias("gini"), (1 - F.col("square") / (total * total)).alias("herfindahl"), (F.log2(total) - F.col("bits") / total).alias("shannon"))


def dispersion(counts: DataFrame, count: str = "n") -> DataFrame:
    """K (N^2 - sum f^2) / (N^2 (k - 1)). Products of counts are doubles: k N^2 of a million items passes the range of longs."""
    f = F.col(count).cast("double")
    s = counts.agg(F.count("*").cast("double").alias("k"), F.sum(f).alias("n"), F.sum(f * f).alias("s"))
    k, n = F.col("k"), F.col("n")
    return s.select(F.try_divide(k * (n * n - F.col("s")), n * n * (k - 1)).alias("dispersion"))
