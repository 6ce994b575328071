"""The feature build in its versions (Q25, Q28, Q30): the base block and others beside it, each a registered query."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import times as T
from ..operators import features as B
from ..operators.sparse import top_per
from ..sources.cuts import clustered, discard, gathered, share, small, written
from ..sources.tables import candidates, table
from .base import register as q
from .features import _END, _PARTS, CAND, R6, _endorsement


@q("q25_day_part_counts", f"SELECT user_id, {_PARTS} FROM events GROUP BY ALL")
def q25_parts(spark, d):
    return B.part_counts(table(spark, d, "events", "user_id", "ts"), ["user_id"], {p: T.in_part("ts", p) for p in T.DAY_PARTS})


@q("q25_user_endorsement", f"WITH {_END} SELECT user_id, max(x)::BIGINT AS high, round(avg(x), 6) AS mean FROM e GROUP BY 1")
def q25_endorsement(spark, d):
    return _endorsement(spark, d).groupBy("user_id").agg(F.max("x").alias("high"), F.round(F.avg("x"), 6).alias("mean"))


#: Block: its query, its keys and its other columns.
BLOCKS = {
    "history": ("q03_user_history_features", ["user_id"], ["n", "mean_quantity", "std_price", "median_quantity", "promo_share", "categories", "favourite"]),
    "parts": ("q25_day_part_counts", ["user_id"], list(T.DAY_PARTS)),
    "endorsement": ("q25_user_endorsement", ["user_id"], ["high", "mean"]),
    "hours": ("q31_hour_weighted_means", ["user_id"], ["mean"]),
    "shares": ("q34_activity_features", ["user_id", "category"], ["n", "share", "activity"]),
    "history_trend": ("q13_add_history_trend", ["user_id", "article"], ["user_trend", "topics_trend"]),
    "delays": ("q11_add_mean_delays", ["user_id", "article"], ["age"]),
    "names": ("r26_topic_scores", ["user_id", "article"], ["total", "high", "mean"]),
    "recommender": ("r25_candidate_scores", ["user_id", "article"], ["score"]),
    "trend": ("q05_topic_trendiness", ["article", "day"], ["trend"]),
    "category_trend": ("q06_category_trendiness", ["article", "day"], ["trend"]),
}
BASE = "q28_q39_build_features"
#: Rows that are in a shuffle at once; more are moved in rounds, ROUNDS at most, each with its share of the keys.
AT_ONCE, ROUNDS = 5_000_000, 4


def _rounds(spark, d) -> int:
    return max(1, min(ROUNDS, -(-table(spark, d, "lineitem").count() // AT_ONCE)))


def _rows(spark, d, rounds: int):
    """A row per shown item, with what its article and its order say about it, clustered by article. Rows that lack one of these stay, marked by
    `ordered` and `known`, as popularity counts them. `published` and so on are those of the items; `published` stands at one row of each article."""
    lines = candidates(spark, d).select(*CAND, "target", "price", "quantity", "shown")
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(F.col("o_orderkey").alias("impression_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.lit(True).alias("ordered"))
    of = lambda x, key, k: x.where(share(key, k, rounds))
    x = gathered(of(lines, "impression_id", k).join(of(orders, "impression_id", k), "impression_id", "left").withColumn("ts", F.when(F.col("target") == 1, F.col("ts"))) for k in range(rounds))
    part = table(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_name").select(F.col("p_partkey").alias("article"), F.col("p_brand").alias("category"), (F.col("p_type") == "PROMO").alias("promo"), F.col("p_name").alias("name"), F.lit(True).alias("known"))
    a = W.partitionBy("article")
    published = F.when((F.col("at") == 1) & F.col("known"), F.to_date("first")).alias("published")

    def known(k):
        y = of(x, "article", k).join(of(part, "article", k), "article", "left").withColumns({"r": F.sum("target").over(a) / F.count("*").over(a), "first": F.min("shown").over(a), "at": F.row_number().over(a.orderBy("shown"))})
        return y.select(*CAND, "user_id", "target", "price", "quantity", F.to_date("shown").alias("day"), "ts", "ordered", "known", "category", "promo", "name", "r", T.between("DAY", "first", "shown").alias("age"), T.between("DAY", "first", "ts").alias("read_age"), published)

    y = gathered(known(k) for k in range(rounds))
    discard(x)
    return y


def _trends(rows, reads):
    """(name, day, trend) of topics, (category, day, trend), (name, topics_trend): few rows, as names and categories repeat."""
    topics = F.split("name", " ")
    published = rows.where("published is not null").select("name", "category", F.col("published").alias("day"))
    days = rows.where("known").select("name", "day").union(reads.where("known").select("name", F.to_date("ts").alias("day"))).where("name is not null and day is not null").distinct()
    demand = days.select("name", "day", F.explode(F.array_distinct(topics)).alias("topic"))
    trend = B.trendiness(demand, published.select(F.explode(topics).alias("topic"), "day"), 3, "topic").groupBy("name", "day").agg(F.sum("n").alias("trend"))
    demand = rows.where("known").select("category", "day").where("category is not null and day is not null").distinct()
    category = B.trendiness(demand, published.select("category", "day"), 5, "category").withColumnRenamed("n", "category_trend")
    trend, category = small(written(trend)), small(written(category))
    read = reads.where("known").groupBy("name", F.to_date("ts").alias("day")).agg(F.count("*").alias("k")).join(trend, ["name", "day"]).groupBy("name").agg(F.sum(F.col("k") * F.col("trend")).alias("s"), F.sum("k").alias("k"))
    means = read.select(F.explode(topics).alias("topic"), "s", "k").groupBy("topic").agg((F.sum("s") / F.sum("k")).alias("mean"))
    names = rows.where("published is not null and name is not null").select("name").distinct()
    of = names.select("name", F.size(topics).alias("k"), F.explode(F.array_distinct(topics)).alias("topic")).join(means, "topic", "left")
    of = of.groupBy("name").agg(R6(F.sum(F.coalesce("mean", F.lit(0.0))) / F.max("k")).alias("topics_trend"))
    return trend, category, small(written(of))


def _users(reads, trend):
    """A row per user: what the blocks say of it, its reads by category and by topic."""
    u = W.partitionBy("user_id")
    reads = reads.where("user_id is not null")
    known, q = F.col("known"), F.when(F.col("known"), F.col("quantity"))
    x = reads.join(trend, (F.to_date("ts") == trend["day"]) & (reads["name"] == trend["name"]), "left").select("user_id", "ts", "known", "promo", "quantity", "price", F.when(known, F.col("trend")).alias("trend"))
    x = x.repartition("user_id").withColumn("w", 1.0 / (1 + T.between("HOUR", F.col("ts"), F.max("ts").over(u))))
    n = F.count_if(known)
    main = x.groupBy("user_id").agg(
        F.count("*").alias("reads"), F.avg("quantity").alias("mean_quantity"), R6(F.avg(q)).alias("history_mean_quantity"), R6(F.stddev_samp(F.when(known, F.col("price")))).alias("history_std_price"),
        F.median(q).alias("history_median_quantity"), R6(F.try_divide(F.count_if(known & F.col("promo")), n)).alias("history_promo_share"), R6(F.sum(F.col("w") * F.col("quantity")) / F.sum("w")).alias("hours_mean"), R6(F.avg("trend")).alias("history_trend_user_trend"),
    )
    c = reads.where("known").select("user_id", "category").repartition("user_id").groupBy("user_id", "category").agg(F.count("*").alias("n"))
    held = F.col("category").isNotNull()
    c = c.groupBy("user_id").agg(F.sum("n").alias("history_n"), F.count("category").alias("history_categories"), F.min(F.when(held, F.struct((-F.col("n")).alias("n"), F.col("category").alias("v")))).getField("v").alias("history_favourite"), F.collect_list(F.when(held, F.struct("category", "n"))).alias("by_category"))
    t = reads.where("known").select("user_id", "name", "read_age").repartition("user_id").select("user_id", "read_age", F.explode(F.split("name", " ")).alias("topic"))
    t = t.groupBy("user_id", "topic").agg(F.count("*").alias("n"), F.avg("read_age").alias("age")).groupBy("user_id").agg(F.collect_list(F.struct("topic", "n", "age")).alias("by_topic"))
    return main.join(c, "user_id", "left").join(t, "user_id", "left")


def _scores(rows, reads, rounds: int):
    """(user_id, by_article): the candidates of a user with a score from its reads (R25: cosine with a shrinkage of 5, the 20 most similar items of each), as
    the frame of `r25_candidate_scores` has them. Pairs of items are moved once, to their second item, a share of those items a round; the scores of all
    items, of which most are no candidates, are made for a quarter of the users at a time."""
    y = reads.select("user_id", "article").distinct()
    y = y.join(y.groupBy("article").agg(F.count("*").alias("q")), "article")
    lists = written(y.where("user_id is not null").groupBy("user_id").agg(F.collect_list(F.struct("article", "q")).alias("all")).select("all"))

    def similar(k):
        both = lists.select(F.explode(F.filter("all", lambda b: share(b["article"], k, rounds))).alias("b"), "all")
        pairs = both.select(F.col("b.article").alias("j"), F.col("b.q").alias("qj"), F.explode("all").alias("a")).where("a.article <> j")
        dots = pairs.select(F.col("a.article").alias("i"), F.col("a.q").alias("qi"), "j", "qj").repartition("j").groupBy("j", "i", "qi", "qj").agg(F.count("*").alias("dot"))
        w = dots.select("i", "j", (F.col("dot") / (F.sqrt("qi") * F.sqrt("qj") + 5.0 + 1e-6)).alias("value")).withColumn("order", F.round("value", 9))
        return top_per(w, "j", "order", ["i"], 20).drop("order")

    w = gathered(similar(k) for k in range(rounds))
    discard(lists)
    part = lambda x, k: x.where(F.col("user_id").isNotNull() & share("user_id", k, ROUNDS)).select("user_id", "article").distinct()

    def scored(k):
        s = part(reads, k).join(w, F.col("article") == F.col("i")).groupBy("user_id", F.col("j").alias("article")).agg(F.sum("value").alias("score"))
        s = s.join(part(rows.where("ordered and known"), k), ["user_id", "article"], "left_semi")
        return s.groupBy("user_id").agg(F.collect_list(F.struct("article", R6("score").alias("score"))).alias("by_article"))

    done = gathered(scored(k) for k in range(ROUNDS))
    discard(w)
    return done


#: Blocks that need no frame of their own: they come from the rows, their users and their trends.
_INSIDE = {"history", "hours", "shares", "history_trend", "delays", "names", "recommender", "trend", "category_trend"}


def build(spark, d, version: str):
    """The feature frame of one version.

    Rows are 36 million a GB and every block is wide, so they are moved three times only: to their orders, to their articles, to their users. All
    three results are tables in the checkpoint folder, and many rows come there in rounds, so that one shuffle of a share of the rows is on disk at a
    time. The last table has its rows in buckets by user, so the result itself shuffles the users alone. All that a row needs of its
    user (its reads by category and topic, too) stands in one row a user. An order has one user, a part one row.
    """
    names, rounds = B.VERSIONS[version], _rounds(spark, d)
    rows = _rows(spark, d, rounds)
    reads = rows.where("target = 1 and ordered")
    trend, category, topics = _trends(rows, reads)
    users = _users(reads, trend)
    for b in ("parts", "endorsement"):
        if b in names:
            frame = q.queries[BLOCKS[b][0]](spark, d)
            users = users.join(frame.select("user_id", *(F.col(c).alias(f"{b}_{c}") for c in BLOCKS[b][2])), "user_id", "full")
    if "recommender" in names:
        scores = _scores(rows, reads, rounds)
        users = users.join(scores, "user_id", "full")
    users = written(users)
    if "recommender" in names:
        discard(scores)

    i = W.partitionBy("user_id", "impression_id")
    x = clustered(rows.where("ordered and known").drop("ordered", "known", "ts", "promo", "read_age", "published"), "user_id", rounds)
    discard(rows)
    x = x.withColumns({"popularity_rank": F.rank().over(i.orderBy(F.desc("r"))), "price_norm": R6(F.try_divide("price", F.max("price").over(i)))})
    x = x.join(users.hint("merge"), "user_id", "left").join(trend, ["name", "day"], "left").join(category, ["category", "day"], "left").join(topics, "name", "left")
    mine, words = F.col("user_id").isNotNull(), F.split("name", " ")
    found = F.transform(words, lambda w: F.get(F.filter("by_topic", lambda t: t["topic"] == w), F.lit(0)))
    x = x.withColumns({"__c": F.get(F.filter("by_category", lambda c: c["category"] == F.col("category")), F.lit(0)), "__t": found})
    counts, ages = F.transform("__t", lambda t: F.coalesce(t["n"], F.lit(0).cast("long"))), F.filter(F.transform("__t", lambda t: t["age"]), lambda a: a.isNotNull())
    total, of_user = F.aggregate(counts, F.lit(0).cast("long"), lambda s, n: s + n), lambda c: F.when(mine, c)
    inside = {
        "shares_n": F.col("__c.n"), "shares_share": R6(F.col("__c.n") / F.col("history_n")), "shares_activity": F.when(F.col("__c").isNotNull(), F.col("history_n")),
        "history_trend_topics_trend": of_user(F.col("topics_trend")), "names_total": of_user(total), "names_high": of_user(F.array_max(counts)), "names_mean": of_user(R6(total / F.size("__t"))),
        "delays_age": of_user(R6(F.try_divide(F.aggregate(ages, F.lit(0.0), lambda s, a: s + a), F.size(ages)))), "trend_trend": F.col("trend"), "category_trend_trend": F.when(F.col("day").isNotNull(), F.coalesce("category_trend", F.lit(0).cast("long"))),
    }
    if "recommender" in names:
        inside["recommender_score"] = of_user(F.coalesce(F.get(F.filter("by_article", lambda c: c["article"] == F.col("article")), F.lit(0))["score"], F.lit(0.0)))
    # A user whose reads have no category has no favourite, and then no history.
    inside |= {f"history_{c}": F.when(F.col("history_favourite").isNotNull(), F.col(f"history_{c}")) for c in BLOCKS["history"][2]}
    base = (*CAND, "user_id", "day", "target", "category", F.size(words).cast("long").alias("n_topics"), "age", F.coalesce("reads", F.lit(0)).alias("reads"), R6("r").alias("popularity"), "price_norm", "popularity_rank", R6(F.col("quantity") - F.col("mean_quantity")).alias("quantity_diff"))
    held = [f"{b}_{c}" for b in names if b in _INSIDE | {"parts", "endorsement"} for c in BLOCKS[b][2]]
    return x.select(*base, *(inside.get(c, F.col(c)).alias(c) for c in held))


def _sql(version: str) -> str:
    names = B.VERSIONS[version]
    columns = ", ".join(f"{b}.{c} AS {b}_{c}" for b in names for c in BLOCKS[b][2])
    joins = " ".join(f"LEFT JOIN ({q.sql[BLOCKS[b][0]]}) {b} ON " + " AND ".join(f"{b}.{k} = base.{k}" for k in BLOCKS[b][1]) for b in names)
    return f"SELECT base.*, {columns} FROM ({q.sql[BASE]}) base {joins}"


for _version in B.VERSIONS:
    q(f"q30_features_{_version}", _sql(_version))(lambda spark, d, v=_version: build(spark, d, v))
