"""Feature blocks: frames in, frames out, composed lazily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lists as L


def topic_tf_idf(items: DataFrame, key: str = "article", tokens: str = "topics") -> DataFrame:
    """Q2: (key, token, weight): tf * (ln((1 + n) / (1 + df)) + 1), rows normalised to length 1. Tokens of two characters or more, lower-cased."""
    t = items.select(key, F.explode(F.transform(tokens, lambda x: F.lower(x))).alias("token")).where(F.length("token") >= 2)
    tf = t.groupBy(key, "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    n = items.agg(F.count("*").alias("n"))
    w = tf.join(df, "token").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return w.select(key, "token", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))).alias("weight"))


def sparse_cosine(a: DataFrame, b: DataFrame, pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Cosine of token vectors (left, token, weight) and (right, token, weight) for given pairs; 0 where they share no token."""
    na = a.groupBy(left).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("na"))
    nb = b.groupBy(right).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("nb"))
    dots = pairs.join(a.withColumnRenamed("weight", "wa"), left).join(b.withColumnRenamed("weight", "wb"), [right, "token"]).groupBy(left, right).agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    out = pairs.join(dots, [left, right], "left").join(na, left, "left").join(nb, right, "left")
    return out.select(left, right, F.coalesce(F.try_divide("dot", F.col("na") * F.col("nb")), F.lit(0.0)).alias("cosine"))


def history_similarity(candidates: DataFrame, history: DataFrame, topics: DataFrame) -> DataFrame:
    """Q4: per (user, article) candidate: mean, largest, smallest and deviation of the Jaccard similarity of its topics with those of each
    item read, and the mean and largest number of shared topics. Similarities come from distinct item pairs, once each."""
    pairs = candidates.join(history, "user_id")
    a, b = topics.select("article", F.col("topics").alias("ta")), topics.select(F.col("article").alias("seen"), F.col("topics").alias("tb"))
    distinct = pairs.select("article", "seen").distinct().join(a, "article").join(b, "seen")
    measured = distinct.select("article", "seen", L.jaccard("ta", "tb").alias("j"), F.size(F.array_intersect("ta", "tb")).alias("common"))
    return pairs.join(measured, ["article", "seen"]).groupBy("user_id", "article").agg(F.avg("j").alias("mean_j"), F.max("j").alias("max_j"), F.min("j").alias("min_j"), F.stddev_samp("j").alias("std_j"), F.avg("common").alias("mean_common"), F.max("common").alias("max_common"))


def trendiness(demand: DataFrame, published: DataFrame, days: int, value: str) -> DataFrame:
    """Q5/Q6: for each (article, day, value) of `demand`, publications of the value in the `days` days before; 0 outside the calendar.

    A publication counts for each of the days it is recent on, so the range join is an equi join on the day.
    """
    counts = published.groupBy(value, "day").agg(F.count("*").alias("n"))
    ends = published.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    ahead = counts.select(value, F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", days))).alias("day"), "n").groupBy(value, "day").agg(F.sum("n").alias("n"))
    joined = demand.join(ahead, [value, "day"], "left").crossJoin(F.broadcast(ends))
    yesterday = F.date_sub("day", 1)
    inside = (yesterday >= F.col("first")) & (yesterday <= F.col("last"))
    return joined.select(*demand.columns, F.when(inside, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("n"))


def target_encoding(df: DataFrame, key: str, label: str) -> DataFrame:
    """Q32: the label's mean per key, shrunk by its variance within the key over that of all: w = n v / (n v + v_key), 0 <= w <= 1."""
    total = df.agg(F.avg(label).alias("m"), F.var_pop(label).alias("v"))
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(label).alias("mk"), F.var_pop(label).alias("vk")).crossJoin(F.broadcast(total))
    w = F.coalesce(F.try_divide(F.col("n") * F.col("v"), F.col("n") * F.col("v") + F.col("vk")), F.lit(0.0))
    return g.select(key, (w * F.col("mk") + (1 - w) * F.col("m")).alias("encoded"))


def part_counts(df: DataFrame, keys: list[str], parts: dict[str, Column]) -> DataFrame:
    """Q14: rows per key inside each window, in one aggregate."""
    return df.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in parts.items()))


def add_blocks(base: DataFrame, blocks: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """Q28: base with the columns of each block (name, frame, keys) beside it, as name_column; rows a block lacks get nulls. Blocks that share keys
    should follow each other: their joins then share one shuffle of the base."""
    for name, frame, keys in blocks:
        base = base.join(frame.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in frame.columns if c not in keys)), keys, "left")
    return base


#: Q30: the blocks of each version of the feature set, smallest first, those of one key together.
_USER, _PAIR, _DAY = ("history", "parts", "endorsement", "hours"), ("shares", "history_trend", "delays", "names", "recommender"), ("trend", "category_trend")
VERSIONS = {
    version: tuple(b for b in (*_USER, *_PAIR, *_DAY) if b in blocks)
    for version, blocks in {
        "68f": {"history", "trend"},
        "94f": {"history", "trend", "shares"},
        "115f": {"history", "trend", "shares", "history_trend", "delays", "hours"},
        "127": {"history", "trend", "shares", "history_trend", "delays", "hours", "parts", "category_trend", "endorsement"},
        "142": {"history", "trend", "shares", "history_trend", "delays", "hours", "parts", "category_trend", "endorsement", "names"},
        "147": {"history", "trend", "shares", "history_trend", "delays", "hours", "parts", "category_trend", "endorsement", "names", "recommender"},
    }.items()
}
