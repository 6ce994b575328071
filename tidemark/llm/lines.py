"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Share of a site's pages beyond which a line is boilerplate, and the pages that must hold it at least.
RATIO, LEAST = 0.05, 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(text: Column) -> Column:
    """What is compared, line by line: 128 bits that stand for the line without spaces around it; null for a blank line."""
    return F.transform(_lines(text), lambda x: F.when(F.trim(x) != "", F.md5(F.trim(x).cast("binary"))))


def drop_lines(docs: DataFrame, ratio: float = RATIO, least: int = LEAST, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with n_lines and n_dropped beside its columns, its text without the boilerplate lines.

    A line goes where pages of the site that hold it / all pages of the site > ratio, and at least `least` pages hold it: with 1, the ratio alone decides, so a
    site of fewer than 1 / ratio pages keeps no line; 2 spares lines that are on one page only. Null
    sites are one site. Blank lines are never counted or dropped. Null text stays null, with 0 lines. Rows of equal id are pages of
    their own, rows repeated in full too. Columns n_lines and n_dropped of docs are replaced.

    A page counts a line once, before anything is shuffled, and (site, line) pairs are added up map-side, so a site with a third of all pages is one
    row a line and task. What a site drops is written first and joined as one row a site: at most 1 / ratio times the lines of its
    average page. It depends on what the pages hold alone, so a task that is run again drops the same lines.
    """
    text = F.col(f"`{text_col}`")
    # Whole rows travel as one struct, so no column of theirs can clash with those used here.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"), F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("\0null")).alias("site"))
    held = rows.select("site", F.explode(F.array_distinct(_keys(F.col("text")))).alias("line")).where("line is not null").groupBy("site", "line").agg(F.count("*").alias("n"))
    # Written first, so that the plan knows its size: few sites are broadcast, and pairs never move to their site's one task.
    pages = materialize(rows.groupBy("site").agg(F.count("*").alias("pages")), "pages")
    common = held.where(F.col("n") >= least).join(pages, "site").where(F.col("n") > ratio * F.col("pages"))
    common = materialize(common.groupBy("site").agg(F.collect_list("line").alias("common")), "lines")
    out = rows.join(common, "site", "left").withColumn("keys", _keys(F.col("text")))
    out = out.withColumn("gone", F.when(F.col("common").isNotNull(), F.array_intersect("keys", "common")))
    dropped = lambda key: key.isNotNull() & F.array_contains("gone", F.coalesce(key, F.lit("")))
    kept = F.array_join(F.filter(_lines(F.col("text")), lambda x, i: ~dropped(F.get("keys", i))), "\n")
    new = F.when(F.size("gone") > 0, kept).otherwise(F.col("text"))
    count = F.when(F.size("gone") > 0, F.size(F.filter("keys", dropped)))
    # Computed before names of docs come back.
    made = {"n_lines": F.coalesce(F.size("keys"), F.lit(0)).cast("long"), "n_dropped": F.coalesce(count, F.lit(0)).cast("long")}
    out = out.select("row", F.struct(new.alias("text"), *(c.alias(n) for n, c in made.items())).alias("made"))
    field = lambda c: F.col("made")["text"] if c == text_col else F.col("row").getField(c)
    return out.select(*(field(c).alias(c) for c in docs.columns if c not in made), *(F.col("made")[n].alias(n) for n in made))


ORACLE = f"""WITH l AS (SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents WHERE text IS NOT NULL),
p AS (SELECT coalesce(source, chr(1)) AS site, count(*) AS pages FROM documents GROUP BY 1),
common AS (SELECT site, trim(line) AS line FROM l JOIN p USING (site) WHERE trim(line) <> '' GROUP BY site, trim(line), pages HAVING count(DISTINCT doc_id) > {RATIO} * pages),
k AS (SELECT doc_id, count(*) AS n_lines, count(c.line) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY place) FILTER (WHERE c.line IS NULL), '') AS text FROM l LEFT JOIN common c ON l.site = c.site AND trim(l.line) = c.line GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text FROM documents d LEFT JOIN k USING (doc_id)"""
