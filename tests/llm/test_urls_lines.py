import random
from collections import Counter

import duckdb
import pytest

from tidemark.llm import lines, urls

SMALL = "/root/testdata/sf0.001"


def test_split_and_rules(spark):
    cases = {
        "HTTP://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "x://example.com": ("example.com", "", None, "allow"),
        "x://com/": ("com", "/", "com/", "allow"),
        "x://xcom/": ("xcom", "/", None, "allow"),
        "http://é.NET/fr/": ("é.net", "/fr/", "net/fr/", "block"),
        "http://a.net?x://b/fr/": ("a.net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "://h/p://q": ("h", "/p://q", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(cases)], "page_id long, url string, host int, template string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def verdicts(spark, rows, rules=urls.RULES):
    return {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}


def test_purity_rejects_unruled_siblings(spark):
    rules = (("bad.org", "/ads/1", "block"), ("bad.org", "/news/1", "allow"))
    rows = [(i, f"http://bad.org/ads/1{i}") for i in range(60)] + [(100, "http://bad.org/ads/777"), (101, "http://bad.org/news/2")] + [(200 + i, f"http://bad.org/news/1{i}") for i in range(60)]
    got = verdicts(spark, rows, rules)
    assert got[100]["verdict"] == "block" and got[101]["verdict"] == "allow"
    assert got[100]["template"] == "ads/*" and got[101]["template"] == "news/*"


def test_the_tree_decides_pages(spark):
    """Rules on some numbers of a directory reject the rest of it on the given pages too; without the tree they would pass."""
    rules = tuple(("net", f"/es/{d}", "block") for d in range(1, 7)) + (("com", "/", "allow"),)
    pages = spark.read.parquet(f"{SMALL}/../sf0.1/pages.parquet")
    got = urls.judge(pages, rules).where("rule is null").collect()
    assert all(r["purity"] is not None for r in got)
    rejected = [r for r in got if r["verdict"] == "block"]
    assert rejected and all(r["path"].startswith("/es/") and r["host"].endswith(".net") for r in rejected)


def test_variable_segments(spark):
    rows = [(i, f"http://h.org/u/name{chr(97 + i % 26)}{chr(97 + i // 26)}/p") for i in range(40)]
    assert {r["template"] for r in verdicts(spark, rows).values()} == {"u/*/p"}


def test_segments_of_every_depth_count(spark):
    deep = "/".join("abcdefghij") + "/" + "/".join("k" * 30)
    rules = (("h.org", f"/{deep}/x1", "block"),)
    rows = [(i, f"http://h.org/{deep}/x{'1' if i < 40 else '2'}{i}") for i in range(50)] + [(100 + i, f"http://h.org/{deep}/y/{i}") for i in range(50)]
    got = verdicts(spark, rows, rules)
    assert all(r["template"].count("/") >= 40 for r in got.values())
    assert all(got[i]["verdict"] == "block" for i in range(50)) and all(got[i]["verdict"] == "allow" for i in range(100, 150))


def test_similar_branches_merge_and_others_do_not(spark):
    rows = [(k * 100 + i, f"http://a.net/{name}/{i}") for k, name in enumerate(["es", "fr", "en", "de"]) for i in range(50)]
    got = verdicts(spark, rows)
    assert {r["template"] for r in got.values()} == {"es|fr/*", "de|en/*"}
    assert all(r["verdict"] == ("block" if k < 200 else "allow") for k, r in got.items())


def test_purity_comes_down_from_host_and_domain(spark):
    rules = (("x.a.org", "/", "block"), ("y.a.org", "/p/", "block"))
    rows = [(i, f"http://x.a.org/{i}") for i in range(80)] + [(100 + i, f"http://y.a.org/p/{i}") for i in range(30)] + [(200, "http://y.a.org/q"), (201, "http://z.a.org/q"), (202, "http://b.edu/q")]
    rows += [(300 + i, f"http://c{i}.com/") for i in range(200)]
    got = verdicts(spark, rows, rules)
    assert got[200]["verdict"] == got[201]["verdict"] == "block" and got[202]["verdict"] == "allow" == got[300]["verdict"]


def test_wide_level_keeps_ruled_segments_apart(spark):
    # Twenty first segments and more, two of them blocked by rules: no page of the others changes its verdict.
    for n in (10, 30):
        names = ["es", "fr", "en", *(f"dir{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n))]
        rows = [(k * 100 + i, f"http://a.net/{name}/{i}") for k, name in enumerate(names) for i in range(9 if k > 2 else 60)]
        got = verdicts(spark, rows)
        assert len(got) == len(rows)
        assert all(r["verdict"] == ("block" if k < 200 else "allow") for k, r in got.items())
        assert {r["template"].split("/")[0] for r in got.values()} == ({"es|fr", "*|en"} if n == 30 else {"es|fr", "|".join(sorted(names[2:]))})


def test_rare_blocked_segments_have_a_wildcard_of_their_own(spark):
    rules = (("h.org", "/bad", "block"),)
    rows = [(k * 100 + i, f"http://h.org/{'bad' if k < 4 else 'dir'}{chr(97 + k // 26)}{chr(97 + k % 26)}/{i}") for k in range(60) for i in range(9)]
    got = verdicts(spark, rows, rules)
    assert {(r["template"], r["verdict"]) for r in got.values()} == {("*high/*", "block"), ("*/*", "allow")}


def test_deep_random_tree_equals_sql(spark):
    rnd = random.Random(4)
    part = lambda: rnd.choice(["en", "es", "fr", "a", "b", "c7", "", "*", "x" + rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 3)])
    rows = [(i % 1900, f"http://{rnd.choice(['a', 'b.c', 'www'])}.{rnd.choice(['net', 'example.com', 'org'])}/" + "/".join(part() for _ in range(rnd.randint(0, 5))) + rnd.choice(["", "?q", "#f", "/"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    rel = con.sql(urls.oracle())
    out = urls.judge(df)
    at = [rel.columns.index(c) for c in out.columns]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    assert urls.judge(df).count() == 3
    assert urls.judge(df.limit(0)).count() == 0


def plain_lines(rows, ratio=lines.RATIO, least=lines.LEAST):
    pages, held = Counter(), Counter()
    for _, t, s in rows:
        pages[s] += 1
        held.update({(s, x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")})
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        all_lines = t.split("\n")
        keep = [x for x in all_lines if not x.strip(" ") or held[s, x.strip(" ")] < least or held[s, x.strip(" ")] <= ratio * pages[s]]
        out.append((i, "\n".join(keep), len(all_lines), len(all_lines) - len(keep)))
    return out


@pytest.mark.parametrize("ratio,least", [(lines.RATIO, lines.LEAST), (lines.RATIO, 2), (0.5, 1)])
def test_lines_equal_plain(spark, odd_rows, ratio, least):
    rows = [(100 + i, f"menu\nbody {i}\n\n menu \nfoot {i % 40}", f"s{i % 3}") for i in range(90)]
    rows += [(i, t, None) for i, t in odd_rows] + [(300, "alone\nmenu", "tiny"), (301, "alone", "tiny")] + [(400, "twice\ntwice", "u")] * 3 + [(401 + i, f"u{i}", "u") for i in range(60)]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, gone int")
    order = lambda x: tuple(str(v) for v in x)
    want = sorted(plain_lines(rows, ratio, least), key=order)
    # As it comes, and from a shuffle in which equal rows have no fixed order.
    for given in (df, df.repartition(5)):
        got = lines.drop_lines(given, ratio, least).select("doc_id", "text", "n_lines", "n_dropped").collect()
        assert sorted(map(tuple, got), key=order) == want


def test_lines_keep_columns(docs, odd_rows):
    df = docs(odd_rows)
    out = lines.drop_lines(df)
    assert set(out.columns) == set(df.columns) | {"n_dropped"}
    assert lines.drop_lines(docs([])).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    from tidemark.llm import registry

    for name, sql in registry.ORACLE.items():
        df = registry.QUERIES[name](spark, SMALL)
        rel = con.sql(sql)
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
