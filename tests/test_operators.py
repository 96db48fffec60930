"""Operators on small tables written for the case."""

import pandas as pd
from pyspark.sql import functions as F

from jobloom.functions import numbers as N
from jobloom.functions import text as X
from jobloom.operators import clustering as C
from jobloom.operators import gates as G
from jobloom.operators import pacing as P
from jobloom.plans.queries import ORACLE_SQL, QUERIES
from jobloom.sources import payloads as L
from tests.compare import duck, shown


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_company_names(spark):
    cases = [("Foo Co., Ltd.", "foo"), ("株式会社フー", "フー"), ("Ｂａｒ（株）", "bar"), ("Acme K.K.", "acme k.k."), ("Inc Media", "inc media"), ("Baz GmbH", "baz"), ("", "")]
    got = values(spark, cases, "a string, b string", X.normalize_company(F.col("a")), "b")
    assert [g[0] for g in got] == [g[1] for g in got]


def test_keys_ignore_case_width_and_blanks(spark):
    rows = [("Foo Inc", "Data  Engineer", "Tokyo"), ("ＦＯＯ, inc.", "data engineer", " tokyo ")]
    keys = values(spark, rows, "a string, b string, c string", X.dedup_key(F.col("a"), F.col("b"), F.col("c")))
    assert keys[0] == keys[1]


def test_title_modes(spark):
    rows = [("Senior Data Engineer", True), ("Sales Manager", False), ("Engineering Lead", True), ("営業", False)]
    roles = F.array(F.lit("Data Engineer"))
    got = values(spark, rows, "t string, hit boolean", G.title_role_match(F.col("t"), roles), "hit", G.title_rejected(F.col("t"), roles, "loose"), G.title_rejected(F.col("t"), roles, "strict"))
    assert [(g[0], g[2], g[3]) for g in got] == [(True, False, False), (False, True, True), (True, False, False), (False, False, True)]


def test_type_and_remote_rules(spark):
    rows = [("Full-time", ["full_time"], False), ("Full Time", ["full_time"], True), (None, ["full_time"], False), ("Contract", [], False)]
    assert [g[0] for g in values(spark, rows, "t string, w array<string>, e boolean", G.type_mismatch(F.col("t"), F.col("w")))] == [r[2] for r in rows]
    rows = [(False, True, "Osaka", ["tokyo"], True), (False, True, "Tokyo, JP", ["tokyo"], False), (None, True, "Osaka", ["tokyo"], False), (False, False, "Osaka", [], False), (False, True, None, None, True)]
    got = values(spark, rows, "r boolean, q boolean, l string, w array<string>, e boolean", G.remote_mismatch(F.col("r"), F.col("q"), F.col("l"), F.col("w")))
    assert [g[0] for g in got] == [r[4] for r in rows]


def test_addresses(spark):
    rows = [("10.1.2.3", True), ("127.0.0.1", True), ("169.254.1.1", True), ("100.64.0.1", True), ("8.8.8.8", False), ("1.1.1.1", False), ("300.1.1.1", None), ("x", None)]
    assert [g[0] for g in values(spark, rows, "i string, e boolean", F.when(G.v4_number(F.col("i")).isNotNull(), G.blocked_v4(F.col("i"))))] == [r[1] for r in rows]
    rows = [("::1", True), ("::ffff:10.0.0.1", True), ("64:ff9b::a00:1", True), ("2606:4700:4700::1111", False), ("bad", None)]
    assert [g[0] for g in values(spark, rows, "i string, e boolean", X.blocked_v6("i"))] == [r[1] for r in rows]


def test_html_keeps_escaped_tags(spark):
    rows = [("<p>a</p><p>b &lt;c&gt; &amp; d</p>",), ("x<br>y &eacute;",), (None,)]
    assert [g[0] for g in values(spark, rows, "h string", X.html_to_text(F.col("h")))] == ["a\nb <c> & d", "x\ny é", ""]


def test_html_with_cut_references(spark):
    """All of HTML's references are decoded, cut ones too; where references are named, those alone, with their semicolon."""
    rows = [("a&amp&quot;{b &lt; c&amp",), ("&amp;quot; &copy;",)]
    assert [g[0] for g in values(spark, rows, "h string", X.html_to_text(F.col("h")))] == ['a&"{b < c&', "&quot; ©"]
    assert [g[0] for g in values(spark, rows, "h string", X.html_to_text(F.col("h"), ("quot", "copy", "middot", "amp")))] == ['a&amp"{b &lt; c&amp', "&quot; ©"]


def test_text_of_pages_with_cut_references_equals_sql(spark, tmp_path):
    html = ["<p>und&amp{margin:0}</p>", "x&amp;&am<br>y&copy;&lt;b&gt; &quot", "<div>a \t</div>\n\n\n&middot;&amp;amp;"]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    pages = pd.DataFrame({"page_id": range(len(html)), "html": html})
    assert shown(QUERIES["q08"](spark, str(tmp_path)).toPandas()) == shown(duck(ORACLE_SQL["q08"], pages=pages))


def test_outcomes_drift(spark):
    rows = [('{"score": "73", "matched": "a", "concerns": null}',), ('{"score": "73/100"}',), ('{"score": 40, "matched": ["x", "y"]}',), ("{",), (None,)]
    got = values(spark, rows, "r string", N.parse_outcome(F.col("r"))["score"], N.parse_outcome(F.col("r"))["matched"])
    assert [g[0] for g in got] == [73, None, 40, None, None] and got[0][1] == ["a"] and got[2][1] == ["x", "y"]


def test_salary_units(spark):
    rows = [(30.0, None, None, "month", "JPY", 360, None), (None, None, 2.0, "hour", None, 4160, 4160), (5.0, 6.0, None, "year", "USD", None, None)]
    pay = N.annual_salary(F.col("lo"), F.col("hi"), F.col("one"), F.col("u"), F.col("c"))
    got = values(spark, rows, "lo double, hi double, one double, u string, c string, a long, b long", pay["salary_min"], pay["salary_max"])
    assert [tuple(g) for g in got] == [r[5:] for r in rows]


def test_redaction_and_mail(spark):
    m = X.redact_map(F.create_map(F.lit("email"), F.lit("ann@x.jp"), F.lit("X-Token"), F.lit("s"), F.lit("path"), F.lit("a@b")))
    assert spark.range(1).select(m).first()[0] == {"email": "a***@x.jp", "X-Token": "***", "path": "a@b"}
    a, b = values(spark, [(" A@x.jp",), ("a@X.jp ",)], "e string", X.hash_email(F.col("e"), F.lit("k")))
    assert a == b and len(a[0]) == 64


def test_best_view_equals_a_fold(spark):
    import random

    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, 1, 2, 3, 4])) for k in range(20) for i in range(12)]
    got = {r["k"]: (r["view"]["i"], r["best_score"]) for r in C.best_view(spark.createDataFrame(rows, "k int, i int, s int"), ["k"], ["i"], "s").collect()}
    for k in range(20):
        view = best = None
        for kk, i, s in rows:
            if kk == k and (s is None or best is None or s >= best):
                view, best = i, best if s is None else s
        assert got[k] == (view, best)


def test_rate_limit_and_streak(spark):
    hits = spark.createDataFrame([("a", i) for i in range(5)], "k string, t int")
    assert [r[0] for r in P.fixed_window_limit(hits, ["k"], F.col("t"), ["t"], 3, 3600).orderBy("t").select("allowed").collect()] == [True, True, True, False, False]
    runs = spark.createDataFrame([("s", i, ok) for i, ok in enumerate([False, False, True, False])], "k string, t int, ok boolean")
    assert [r[0] for r in P.failure_streak(runs, "k", ["t"], F.col("ok")).orderBy("t").select("streak").collect()] == [1, 2, 0, 1]


def test_crawl_rules(spark):
    urls = spark.createDataFrame([("h", "/a/b"), ("h", "/a/c"), ("g", "/a"), ("h", "/")], "host string, path string")
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/a/c", True), ("h", "", False)], "host string, prefix string, allow boolean")
    got = {(r["host"], r["path"]): r["decision"] for r in G.crawl_decision(urls, rules).collect()}
    assert got == {("h", "/a/b"): "disallowed", ("h", "/a/c"): "allowed", ("g", "/a"): "allowed", ("h", "/"): "allowed"}


def test_json_ld(spark):
    graph = '<script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "A", "url": "/j"}, {"@type": "Org"}]}</script><script type="application/ld+json">{bad</script>'
    twice = '<script type="application/ld+json">[{"@type": ["JobPosting"], "title": "B", "url": "http://o/x"}, {"@type": "JobPosting", "title": "C", "url": "http://o/x"}]</script>'
    pages = spark.createDataFrame([(1, "http://h/p", graph), (2, "http://h/p", twice), (3, "http://h/p", "none"), (4, None, None)], "id int, url string, html string")
    got = {(r["id"], r["url"], r["title"]) for r in L.extract_job_postings(pages, "id", "url", "html").collect()}
    assert got == {(1, "http://h/j", "A"), (2, "http://o/x", "C")}


def test_bad_payloads(spark):
    landed = spark.createDataFrame([("s", "object", "b", "{bad"), ("s", "object", "b", '{"jobs": []}'), ("s", "list", "b", "[]"), ("s", "list", "b", "{}")], "source_id string, vendor string, board_id string, body string")
    assert L.bad_payloads(landed).count() == 2
