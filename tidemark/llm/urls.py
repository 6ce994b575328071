"""URL filters: host and path rules, and a per-host template tree judged by smoothed labelled purity. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path prefix, verdict): the rules of the registered query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Distinct values under one parent from which its rare ones are a variable (rare: at most this part of the parent's urls), the weight of a node's
#: parent in its purity, chi-square with one degree of freedom from which two shares differ (5 %), and the purity from which a template is rejected.
VARIABLE, WEIGHT, DIFFERENT, REJECT = 20, 4, 3.84, 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where the url is null or has no '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls. A rule list is configuration, so it becomes one expression."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = lambda r: ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])
    name = reduce(lambda e, r: e.when(fits(r), F.lit(r[0] + r[1])), ordered, F.when(F.lit(False), F.lit("")))
    verdict = reduce(lambda e, r: e.when(fits(r), F.lit(r[2])), ordered, F.when(F.lit(False), F.lit("")))
    return name, verdict


def differ(bad1: Column, n1: Column, bad2: Column, n2: Column) -> Column:
    """Whether two shares differ by the chi-square test on their two by two table."""
    a, b, c, d = (x.cast("double") for x in (bad1, n1 - bad1, bad2, n2 - bad2))
    cross = a * d - b * c
    return (cross != 0) & ((a + b + c + d) * cross * cross >= DIFFERENT * (a + b) * (c + d) * (a + c) * (b + d))


def _smoothed(bad: Column, n: Column, parent: Column) -> Column:
    return (bad + WEIGHT * parent) / (n + WEIGHT)


def _hosts(shapes: DataFrame) -> DataFrame:
    """(host, purity): from the share over all urls down the host's labels, `net` before `example.net`, each smoothed by the one before."""
    top = shapes.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.0)).alias("purity"))
    labels = F.split("host", r"\.")
    hosts = shapes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    ends = hosts.select("host", "n", "bad", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))).alias("k", "end"))
    sums = ends.groupBy("end").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    chain = ends.select("host", "k", "end").join(sums, "end").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("k", "n", "bad"))).alias("chain"))
    chain = chain.crossJoin(F.broadcast(top))
    return chain.select("host", F.aggregate("chain", F.col("purity"), lambda p, x: _smoothed(x["bad"], x["n"], p)).alias("purity"))


def _level(now: DataFrame, i: int) -> DataFrame:
    """One level deeper: `now` with the template's next segment and its purity."""
    node = ["host", "template"]
    rows = now.withColumn("child", F.col("parts")[i])
    kids = rows.groupBy(*node, "purity", "child").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = kids.groupBy(*node).agg(F.count("*").alias("width"), F.sum("n").alias("all"), F.sum("bad").alias("all_bad"))
    kids = kids.join(whole, node)
    rest = F.col("all") - F.col("n"), F.col("all_bad") - F.col("bad")
    apart = differ(F.col("bad"), F.col("n"), rest[1], rest[0])
    more = F.col("bad") * rest[0] > rest[1] * F.col("n")
    rare = (F.col("width") >= VARIABLE) & (F.col("n") * VARIABLE <= F.col("all"))
    kids = kids.select(*node, "purity", "child", "n", "bad", F.when(~rare, F.col("child")).when(~apart, F.lit("*")).when(more, F.lit("*high")).otherwise(F.lit("*low")).alias("name"))
    # At most VARIABLE names and three wildcards are left under a parent.
    names = kids.groupBy(*node, "purity", "name").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    order = W.partitionBy(*node).orderBy(F.desc(F.col("bad") / F.col("n")), "name")
    names = names.withColumn("new", F.coalesce(differ(F.col("bad"), F.col("n"), F.lag("bad").over(order), F.lag("n").over(order)), F.lit(True)))
    names = names.withColumn("branch", F.sum(F.col("new").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = names.groupBy(*node, "branch").agg(F.array_join(F.sort_array(F.collect_list("name")), "|").alias("label"), _smoothed(F.sum("bad"), F.sum("n"), F.first("purity")).alias("purity"))
    names = names.select(*node, "name", "branch").join(merged, [*node, "branch"]).drop("branch")
    kids = kids.select(*node, "child", "name").join(names, [*node, "name"]).drop("name")
    found = rows.drop("purity").join(kids, [*node, "child"])
    return found.select("host", "parts", "n", "bad", F.concat("template", F.lit("/" if i else ""), "label").alias("template"), "purity")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every url; repeated rows and null ids stay.

    The tree: all segments of a path, with digit runs as '*', under its host. Level by level:

    1. Where VARIABLE or more distinct values follow one parent, the rare ones become a wildcard. Those whose share of urls that a rule blocks
       differs from that of the rest become wildcards of their own, '*high' and '*low'.
    2. Branches of one parent, by that share, merge with their neighbours as long as the shares do not differ; a merged branch has all names, joined by '|'.
    3. A node's purity is its share of blocked urls, smoothed by its parent's: the host's for the first level, and above it those of the domains it
       is in, up to the share over all urls. A url that no rule decides counts as one that no rule objects to, so a rule on one directory
       rejects its siblings only where most of what is above them is blocked. So every url has a purity.

    A url that no rule decides is blocked if its template's purity reaches REJECT. Counts are combined before each shuffle; under one parent at most
    VARIABLE names and three wildcards are compared. A level is a written table, read by the next; a level's urls are those that have it.
    """
    host, path = split_url(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    part = F.regexp_replace(F.regexp_replace("path", "[0-9]+", "*"), "^/+|/+$", "")
    part = F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, "/+"))
    base = base.select("*", name.alias("rule"), verdict.alias("ruled"), part.alias("parts"))
    shapes = materialize(base.groupBy("host", "parts").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("bad")), "shapes")
    deepest = shapes.agg(F.max(F.size("parts"))).first()[0] or 0
    now = shapes.join(_hosts(shapes), "host").select("host", "parts", "n", "bad", F.lit("").alias("template"), "purity")
    done, levels = [], []
    for i in range(deepest + 1):
        now = materialize(now, "level")
        levels.append(now)
        done.append(now.where(F.size("parts") == i).select("host", "parts", "template", "purity"))
        if i < deepest:
            now = _level(now.where(F.size("parts") > i), i)
    judged = materialize(reduce(DataFrame.unionByName, done), "judged")
    discard(shapes, *levels)
    out = base.join(judged, ["host", "parts"])
    final = F.coalesce("ruled", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def oracle(levels: int = 6) -> str:
    """The same in DuckDB's SQL, for tables whose paths have at most `levels` segments."""
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda k: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[k]}'" for h, p, v in ordered) + " END"
    cross = "(bad::DOUBLE * (n2 - bad2) - (n - bad)::DOUBLE * bad2)"
    apart = f"({cross} <> 0 AND (n + n2)::DOUBLE * {cross} * {cross} >= {DIFFERENT}::DOUBLE * n::DOUBLE * n2 * (bad + bad2) * (n - bad + n2 - bad2))"
    tree = []
    for i in range(1, levels + 1):
        tree.append(f"""k{i} AS (SELECT host, template, purity, parts[{i}] AS child, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM t{i - 1} WHERE len(parts) >= {i} GROUP BY ALL),
l{i} AS (SELECT *, sum(n) OVER w - n AS n2, sum(bad) OVER w - bad AS bad2, count(*) OVER w >= {VARIABLE} AND n * {VARIABLE} <= sum(n) OVER w AS rare FROM k{i} WINDOW w AS (PARTITION BY host, template)),
m{i} AS (SELECT host, template, purity, child, n, bad, CASE WHEN NOT rare THEN child WHEN NOT {apart} THEN '*' WHEN bad * n2 > bad2 * n THEN '*high' ELSE '*low' END AS name FROM l{i}),
o{i} AS (SELECT host, template, purity, name, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM m{i} GROUP BY ALL),
p{i} AS (SELECT *, lag(n) OVER w AS n2, lag(bad) OVER w AS bad2 FROM o{i} WINDOW w AS (PARTITION BY host, template ORDER BY bad::DOUBLE / n DESC, name)),
q{i} AS (SELECT *, sum(CASE WHEN coalesce({apart}, true) THEN 1 ELSE 0 END) OVER (PARTITION BY host, template ORDER BY bad::DOUBLE / n DESC, name ROWS UNBOUNDED PRECEDING) AS branch FROM p{i}),
r{i} AS (SELECT host, template, branch, string_agg(name, '|' ORDER BY name) AS label, (sum(bad)::DOUBLE + {WEIGHT} * any_value(purity)) / (sum(n) + {WEIGHT}) AS purity FROM q{i} GROUP BY ALL),
t{i} AS (SELECT t.host, t.parts, t.n, t.bad, concat(t.template, '{"/" if i > 1 else ""}', r.label) AS template, r.purity FROM t{i - 1} t
  JOIN m{i} m ON m.host = t.host AND m.template = t.template AND m.child = t.parts[{i}] JOIN q{i} q ON q.host = t.host AND q.template = t.template AND q.name = m.name
  JOIN r{i} r ON r.host = t.host AND r.template = t.template AND r.branch = q.branch WHERE len(t.parts) >= {i} UNION ALL SELECT * FROM t{i - 1} WHERE len(parts) < {i})""")
    return f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, rest FROM u),
b0 AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
b1 AS (SELECT *, {case(0)} AS rule, {case(1)} AS ruled, regexp_replace(regexp_replace(path, '[0-9]+', '*', 'g'), '^/+|/+$', '', 'g') AS part FROM b0),
base AS (SELECT page_id, host, path, rule, ruled, CASE WHEN part = '' THEN [] ELSE string_split_regex(part, '/+') END AS parts FROM b1),
shapes AS (SELECT host, parts, count(*) AS n, count(*) FILTER (WHERE ruled = 'block') AS bad FROM base GROUP BY ALL),
hosts AS (SELECT host, string_split(host, '.') AS labels, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM shapes GROUP BY ALL),
ends AS (SELECT host, n, bad, k, array_to_string(labels[len(labels) - k + 1:], '.') AS stop FROM hosts, unnest(range(1, len(labels) + 1)) AS x(k)),
sums AS (SELECT stop, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM ends GROUP BY ALL),
top AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(n), 0), 0.0) AS purity FROM shapes),
chain AS (SELECT e.host, list_prepend({{'n': 0.0::DOUBLE, 'bad': 0.0::DOUBLE, 'p': any_value(top.purity)}}, list({{'n': s.n, 'bad': s.bad, 'p': 0.0::DOUBLE}} ORDER BY k)) AS steps FROM ends e JOIN sums s USING (stop), top GROUP BY e.host),
t0 AS (SELECT s.host, s.parts, s.n, s.bad, '' AS template, list_reduce(steps, lambda a, x: {{'n': 0.0::DOUBLE, 'bad': 0.0::DOUBLE, 'p': (x.bad + {WEIGHT} * a.p) / (x.n + {WEIGHT})}}).p AS purity FROM shapes s JOIN chain c ON c.host = s.host),
{", ".join(tree)}
SELECT page_id, b.host, path, rule, coalesce(ruled, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity FROM base b JOIN t{levels} t ON t.host = b.host AND t.parts = b.parts"""
