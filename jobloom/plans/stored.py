"""Queries on stored tables: keys of odd names, run outcomes, ownership, patches, validity, routes, texts, incremental ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import clustering as C
from ..operators import gates as G
from ..operators import ingest as I
from ..operators import layout as B
from ..operators import pacing as P
from ..operators import snapshots as D
from ..operators.shared import shared_folder
from ..sources import payloads as L
from ..streaming import streams as R
from .queries import _ATTEMPTS, _ROUTES, BUCKETS, attempts
from .registry import ORACLE_SQL, query, seconds, table, wide


@query("q45", "SELECT p_partkey, sha256(lower(p_brand) || '|' || lower(p_name) || '|' || lower(p_type)) AS dedup_key FROM part")
def q45(spark, d):
    """Company forms at the end or, in Japanese, in front; full-width titles; places with blanks around."""
    k = F.col("p_partkey")
    company = F.col("p_brand")
    for i, form in enumerate((" Inc", ", Inc.", " Co., Ltd.", " GmbH"), 1):
        company = F.when(k % 6 == i, F.concat("p_brand", F.lit(form))).otherwise(company)
    company = F.when(k % 6 == 5, F.concat(F.lit("株式会社"), "p_brand")).otherwise(company)
    title = F.when(k % 4 == 0, wide(F.col("p_name"))).otherwise(F.col("p_name"))
    place = F.when(k % 3 == 0, F.concat(F.lit(" 　"), "p_type", F.lit("\t "))).otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", X.dedup_key(company, title, place).alias("dedup_key"))


@query(
    "q46",
    """WITH a AS (SELECT event_id, [10, 100, 127, 169, 172, 192, 8, 224][1 + event_id % 8] AS a, event_id % 256 AS b, (event_id // 256) % 256 AS c FROM events)
    SELECT event_id, a IN (10, 127, 224) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) AS blocked FROM a""",
)
def q46(spark, d):
    """IPv4 addresses inside IPv6: mapped, and in both translation ranges."""
    first = F.element_at(F.array(*(F.lit(n) for n in (10, 100, 127, 169, 172, 192, 8, 224))), (F.col("event_id") % 8 + 1).cast("int"))
    v4 = F.concat_ws(".", first.cast("string"), (F.col("event_id") % 256).cast("string"), (F.floor(F.col("event_id") / 256) % 256).cast("string"), F.lit("7"))
    head = F.element_at(F.array(*(F.lit(h) for h in ("::ffff:", "64:ff9b::", "64:ff9b:1::"))), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", G.closed_address(F.concat(head, v4)).alias("blocked"))


@query(
    "q47",
    """WITH m AS (SELECT p_partkey, p_size % 4 AS shape, p_retailprice AS v, [1, 12, 2080][1 + p_partkey % 3] AS m FROM part)
    SELECT p_partkey, CAST(CASE WHEN shape < 3 THEN trunc(v * m) END AS BIGINT) AS salary_min, CAST(CASE shape WHEN 1 THEN trunc(v * 2 * m) WHEN 2 THEN trunc(v * m) END AS BIGINT) AS salary_max FROM m""",
)
def q47(spark, d):
    """Pay with one end, both, a single value, or in another currency; units in plural and capitals."""
    shape, v, none = F.col("p_size") % 4, F.col("p_retailprice"), F.lit(None).cast("double")
    unit = F.element_at(F.array(F.lit("Years"), F.lit("MONTH"), F.lit("hours")), F.col("p_partkey").cast("int") % 3 + 1)
    pay = N.annual_salary(F.when(shape.isin(0, 1, 3), v), F.when(shape == 1, v * 2), F.when(shape == 2, v).otherwise(none), unit, F.when(shape == 3, "USD").otherwise("JPY"), False, True)
    return table(spark, d, "part").select("p_partkey", pay["salary_min"].alias("salary_min"), pay["salary_max"].alias("salary_max"))


@query(
    "q48",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL),
    g AS (SELECT user_id, max(k) AS n, max(k) FILTER (WHERE event_type <> 'error') AS good, arg_max(event_type, k) FILTER (WHERE event_type IN ('view', 'click')) AS routed, max(ts) FILTER (WHERE event_type <> 'error') AS success FROM o GROUP BY user_id),
    f AS (SELECT *, CASE WHEN good IS NULL THEN n + user_id % 3 ELSE n - good END AS failures FROM g)
    SELECT user_id AS source_id, CAST(failures AS BIGINT) AS consecutive_failures, CASE WHEN failures >= 2 THEN 'error' ELSE 'active' END AS status, CASE WHEN failures > 0 THEN 'http 500' END AS last_error,
      CASE routed WHEN 'view' THEN 'ats' WHEN 'click' THEN 'json_ld' END AS source_type, CASE routed WHEN 'view' THEN 'v1' END AS ats_vendor, CAST(floor(epoch_us(success) / 1e6) AS BIGINT) AS success FROM f""",
)
def q48(spark, d):
    e = table(spark, d, "events").filter("user_id IS NOT NULL")
    null = lambda kind: F.lit(None).cast(kind)
    sources = e.select(F.col("user_id").alias("source_id")).distinct().select(
        "source_id", F.lit("active").alias("status"), (F.col("source_id") % 3).cast("long").alias("consecutive_failures"), null("string").alias("robots_state"), null("string").alias("last_error"),
        null("string").alias("source_type"), null("string").alias("ats_vendor"), *(null("timestamp").alias(c) for c in ("robots_checked_at", "last_fetched_at", "last_success_at")),
    )
    kind = F.col("event_type")
    runs = e.select(
        F.col("user_id").alias("source_id"), "ts", "event_id", F.col("ts").cast("timestamp").alias("at"), F.when(kind == "error", "http 500").alias("error"),
        F.when(kind == "view", "ats").when(kind == "click", "json_ld").alias("route"), F.when(kind == "view", "v1").alias("vendor"), F.lit("allowed").alias("robots_state"),
    )
    out = D.record_outcomes(sources, runs, ["ts", "event_id"], 2)
    return out.select("source_id", "consecutive_failures", "status", "last_error", "source_type", "ats_vendor", F.floor(seconds("last_success_at")).cast("long").alias("success"))


@query("q49", "SELECT o_custkey AS user_id, o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def q49(spark, d):
    owned = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey")
    asked = owned.select((F.col("user_id") + F.col("o_orderkey") % 2).alias("user_id"), "o_orderkey")
    return C.owned_only(asked, owned, ["user_id", "o_orderkey"])


@query(
    "q50",
    """WITH k AS (SELECT o_custkey, max(o_orderkey) AS keep FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey)
    SELECT o.o_custkey, o.o_orderkey FROM orders o LEFT JOIN k USING (o_custkey) WHERE k.o_custkey IS NULL OR (k.o_custkey % 2 = 0 AND o.o_orderkey = k.keep)""",
)
def q50(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    commands = o.filter("o_custkey % 3 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("keep")).withColumn("keep", F.when(F.col("o_custkey") % 2 == 0, F.col("keep")))
    return C.drop_except(o, "o_custkey", "o_orderkey", commands)


_LAST = "SELECT c_custkey, c_nationkey, c_acctbal, last FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"


def _sources(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("timestamp").alias("last_fetched_at"))
    c = table(spark, d, "customer").join(last, "c_custkey", "left")
    return c.select(F.col("c_custkey").alias("source_id"), "c_nationkey", F.when(F.col("c_acctbal") >= 0, "active").otherwise("paused").alias("status"), "last_fetched_at", (24 * (F.col("c_custkey") % 7 + 1)).alias("fetch_interval_hours"))


@query(
    "q51",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS source, 'job_source.fetch' AS task FROM ({_LAST}) WHERE c_acctbal >= 0 AND (last IS NULL OR last + to_hours(24 * (c_custkey % 7 + 1)) <= TIMESTAMP '1998-08-01')""",
)
def q51(spark, d):
    sent = D.due_messages(_sources(spark, d), F.lit("1998-08-01").cast("timestamp"))
    read = L.decode_envelopes(sent, "body", F.col("source_id"), F.lit("1998-08-01").cast("timestamp"))
    return read.select(F.get_json_object("payload", "$.source_id").alias("source"), "task")


@query("q52", f"SELECT c_nationkey, coalesce(bool_or(c_acctbal >= 0 AND last IS NULL), false) AS waiting FROM ({_LAST}) GROUP BY c_nationkey")
def q52(spark, d):
    return C.any_waiting(_sources(spark, d), ["c_nationkey"])


@query("q53", "SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AS large, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_discount = 0) AS plain FROM part")
def q53(spark, d):
    items = table(spark, d, "lineitem")
    children = [(items.filter("l_quantity > 45"), "p_partkey", "l_partkey", "large"), (items.filter("l_discount = 0"), "p_partkey", "l_partkey", "plain")]
    return C.child_counts(table(spark, d, "part").select("p_partkey"), children)


@query(
    "q54",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'not found' WHEN doc_id % 11 = 0 THEN 'not uploaded' WHEN n_chars > 5000 THEN 'too large' WHEN doc_id % 3 = 0 THEN 'unsupported type' END AS error FROM documents""",
)
def q54(spark, d):
    k = F.col("doc_id")
    owner = F.concat(F.lit("u"), (k % 5).cast("string"))
    user = F.when(k % 7 == 0, F.concat(owner, F.lit("x"))).otherwise(owner)
    kind = F.when(k % 3 == 0, "image/png").otherwise("application/pdf")
    error = G.upload_error(F.concat(F.lit("resumes/"), owner, F.lit("/"), k.cast("string")), user, F.when(k % 11 != 0, F.col("n_chars")), kind, 5000, ("application/pdf", "text/plain"))
    return table(spark, d, "documents").select("doc_id", error.alias("error"))


_RULES = "User-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: third\nDisallow: /en/  # all of it\nAllow: /en/1\nDisallow:\nCrawl-delay: 2\n"


@query(
    "q55",
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages),
    s AS (SELECT *, CASE WHEN host LIKE '%.com' THEN 200 WHEN host LIKE '%.net' THEN 404 WHEN host LIKE 'www.%' THEN 503 END AS status FROM p)
    SELECT page_id, CASE WHEN status = 200 AND path LIKE '/en/%' AND path NOT LIKE '/en/1%' THEN 'disallowed' ELSE 'allowed' END AS decision,
      CASE WHEN status IS NULL OR status = 503 THEN 'unknown' ELSE 'allowed' END AS robots_state, CASE WHEN status = 200 THEN 2.0::DOUBLE END AS crawl_delay FROM s""",
)
def q55(spark, d):
    p = table(spark, d, "pages").select("page_id", F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host"), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")).alias("path"))
    host = F.col("host")
    hosts = p.select("host").distinct().withColumn("status", F.when(host.endswith(".com"), 200).when(host.endswith(".net"), 404).when(host.startswith("www."), 503)).withColumn("body", F.lit(_RULES))
    return G.crawl_decision(p, G.parsed_rules(hosts, "jobbot"), hosts=hosts).select("page_id", "decision", "robots_state", "crawl_delay")


@query("q56", "SELECT page_id, md5(html || CASE WHEN page_id % 5 = 0 AND page_id % 2 = 0 THEN chr(65533) ELSE '' END) AS digest FROM pages")
def q56(spark, d):
    """Pages landed as bytes: utf-8, some with a bad byte at the end, and UTF-16."""
    k, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    utf8 = F.when(k % 5 == 0, F.concat(F.encode(html, "UTF-8"), F.lit(bytes([255])))).otherwise(F.encode(html, "UTF-8"))
    content = F.when(k % 2 == 0, utf8).otherwise(F.encode(html, "UTF-16BE"))
    kind = F.when(k % 2 == 0, "text/html").otherwise('text/html; charset="UTF-16BE"')
    return table(spark, d, "pages").select("page_id", F.md5(L.decoded(content, kind)).alias("digest"))


@query(
    "q57",
    r"""WITH h AS (SELECT page_id, regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^blog\.([a-z0-9]+)\.', 1) AS a, regexp_extract(html, 'track\((\d+)\)', 1) AS e, page_id % 4 = 1 AS failed,
      CASE WHEN page_id % 10 = 3 THEN 404 WHEN page_id % 10 = 4 THEN NULL ELSE 200 END AS status FROM pages),
    s AS (SELECT *, CASE WHEN a <> '' AND a NOT IN ('www', 'example') AND NOT failed THEN 'direct' WHEN page_id % 7 = 0 THEN 'banned' WHEN status IS NULL THEN 'unread' WHEN status >= 400 THEN 'bad'
      WHEN e <> '' AND NOT failed THEN 'embedded' WHEN page_id % 3 = 0 THEN 'json_ld' ELSE 'none' END AS step FROM h)
    SELECT page_id, CASE WHEN step IN ('direct', 'embedded') THEN 'ats' WHEN step = 'json_ld' THEN 'json_ld' END AS route, CASE step WHEN 'direct' THEN 'blog' WHEN 'embedded' THEN 'widget' END AS vendor,
      CASE step WHEN 'direct' THEN a WHEN 'embedded' THEN e END AS board, CASE WHEN step = 'direct' THEN 'unknown' WHEN page_id % 7 = 0 THEN 'disallowed' ELSE 'allowed' END AS robots_state,
      step IN ('banned', 'unread', 'bad', 'none') AS failed, step IN ('banned', 'none') AS needs_manual FROM s""",
)
def q57(spark, d):
    k = F.col("page_id")
    landed = table(spark, d, "pages").select(
        "page_id", "url", (k % 4 == 1).alias("api_failed"), F.when(k % 7 == 0, "disallowed").otherwise("allowed").alias("robots"), F.when(k % 10 == 3, 404).when(k % 10 != 4, 200).alias("page_status"),
        F.when(k % 10 == 4, "timeout").alias("fetch_error"), F.col("url").alias("page_url"), F.col("html").alias("page"), (k % 3 == 0).alias("has_jsonld"),
    )
    out = G.route_sources(landed, _ROUTES[:1], [("widget", r"track\((\d+)\)"), ("strange", r"(.)")], ("www", "example"), ("blog", "widget"))
    return out.select("page_id", "route", "vendor", "board", "robots_state", F.col("error").isNotNull().alias("failed"), "needs_manual")


@query(
    "q58",
    """WITH u AS (SELECT lower(c_name) || '@x.jp' AS email, CASE WHEN c_custkey % 4 = 0 THEN 1 END AS seen FROM customer WHERE c_custkey % 2 = 0), a AS (SELECT DISTINCT lower(c_name) || '@x.jp' AS email FROM customer WHERE c_custkey % 3 = 0)
    SELECT u.email, CASE WHEN a.email IS NOT NULL THEN coalesce(seen, 2) ELSE seen END AS verified FROM u LEFT JOIN a USING (email) UNION ALL SELECT email, 2 FROM a WHERE email NOT IN (SELECT email FROM u)""",
)
def q58(spark, d):
    c = table(spark, d, "customer")
    users = c.filter("c_custkey % 2 = 0").select(F.concat(F.lower("c_name"), F.lit("@x.jp")).alias("email"), F.when(F.col("c_custkey") % 4 == 0, 1).alias("email_verified_at"))
    codes = c.filter("c_custkey % 3 = 0").select(F.concat(F.lit("  "), "c_name", F.lit("@X.jp ")).alias("email"))
    return D.get_or_create_verified(users, codes, F.lit(2)).select("email", F.col("email_verified_at").alias("verified"))


@query(
    "q59",
    """WITH k AS (SELECT p_partkey, p_size % 3 AS user_id, sha256(lower(p_brand) || '|' || lower(p_name) || '|' || lower(p_type)) AS dedup_key FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, dedup_key ORDER BY p_partkey) AS r, EXISTS (SELECT 1 FROM k e WHERE e.p_partkey % 5 = 0 AND e.user_id = b.user_id AND e.dedup_key = b.dedup_key) AS known FROM k b WHERE p_partkey % 5 <> 0)
    SELECT p_partkey, dedup_key, CASE WHEN r = 1 AND NOT known THEN 'accepted' ELSE 'rejected' END AS verdict, 'manual' AS source_type FROM r""",
)
def q59(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 3).alias("user_id"), F.concat("p_brand", F.lit(" Ltd.")).alias("company_name"), F.concat(F.lit(" "), "p_name").alias("title"), F.col("p_type").alias("location"))
    stored = p.filter("p_partkey % 5 = 0").select("user_id", X.dedup_key(F.col("company_name"), F.col("title"), F.col("location")).alias("dedup_key"))
    good, bad = D.manual_entries(p.filter("p_partkey % 5 <> 0"), stored, ["p_partkey"])
    shown = lambda df, verdict: df.select("p_partkey", "dedup_key", F.lit(verdict).alias("verdict"), "source_type")
    return shown(good, "accepted").unionByName(shown(bad, "rejected"))


@query(
    "q60",
    """WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS role, arg_max(event_id % 2 = 0, (ts, event_id)) AS remote_required, arg_max(event_id, (ts, event_id)) AS salary_min FROM events GROUP BY user_id)
    SELECT c_custkey AS user_id, coalesce(role, '') AS roles, coalesce(remote_required, false) AS remote_required, salary_min FROM customer LEFT JOIN l ON user_id = c_custkey""",
)
def q60(spark, d):
    commands = table(spark, d, "events").select("user_id", "ts", "event_id", F.array("event_type").alias("desired_roles"), (F.col("event_id") % 2 == 0).alias("remote_required"), F.col("event_id").alias("salary_min"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    out = D.with_default_preferences(users, D.last_writes(commands, "user_id", ["ts", "event_id"]))
    return out.select("user_id", F.array_join("desired_roles", ",").alias("roles"), "remote_required", "salary_min")


@query("q61", "SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS o_custkey FROM orders")
def q61(spark, d):
    gone = table(spark, d, "customer").filter("c_custkey % 5 = 0").select("c_custkey")
    return D.null_links(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone)


@query(
    "q62",
    """WITH e AS (SELECT user_id, event_id, 1 AS new, CASE WHEN event_type <> 'view' THEN CAST(trunc(value) AS BIGINT) END AS score FROM events WHERE user_id IS NOT NULL
      UNION ALL SELECT DISTINCT user_id, -user_id, 0, CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 20 ELSE 90 END FROM events WHERE user_id IS NOT NULL AND user_id % 4 > 0),
    r AS (SELECT *, max(score) OVER (PARTITION BY user_id ORDER BY new, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e)
    SELECT user_id, arg_max(event_id, (new, event_id)) AS view_event, max(score) AS match_score FROM r WHERE score IS NULL OR best IS NULL OR score >= best GROUP BY user_id""",
)
def q62(spark, d):
    """Stored postings, some with a score, meet a batch; each keeps or changes its view."""
    e = table(spark, d, "events").filter("user_id IS NOT NULL").select("user_id", F.col("event_id").alias("view_event"), F.when(F.col("event_type") != "view", F.col("value").cast("long")).alias("match_score"), F.col("event_id").alias("at"))
    user = F.col("user_id")
    score = F.when(user % 3 == 1, F.lit(20)).when(user % 3 == 2, F.lit(90)).cast("long")
    held = e.filter(user % 4 > 0).select("user_id").distinct().select("user_id", (-user).alias("view_event"), score.alias("match_score"))
    return C.merge_postings(held, e, ["user_id"], ["at"])


@query("q63", "SELECT event_id FROM events WHERE event_type = 'error' OR event_id % 10 = 0")
def q63(spark, d):
    ok = F.when(F.col("event_id") % 10 != 0, F.col("event_type") != "error")
    return C.split_failures(table(spark, d, "events").select("event_id", "event_type"), ok, "event_id")[1]


@query(
    "q64",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') ELSE '' END AS started, CAST(CASE o_orderkey % 4 WHEN 0 THEN 0 ELSE 2 END AS INTEGER) AS n,
    CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') END AS stored FROM orders""",
)
def q64(spark, d):
    """A document's companies: months spelt in ways, missing and blank periods, missing arrays."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    start = F.when(k % 3 == 0, F.concat(F.lit(" "), F.date_format(day, "yyyy-M-dd"))).when(k % 3 == 1, F.lit("spring"))
    done = F.when(k % 4 != 0, F.array(F.lit("a"), F.lit("b")))
    companies = F.array(F.struct(start.alias("period_start"), F.lit(" ").alias("period_end"), done.alias("achievements")))
    shown = table(spark, d, "orders").select("o_orderkey", X.form_companies(companies).alias("c"))
    return shown.select("o_orderkey", F.col("c")[0]["period_start"].alias("started"), F.size(F.col("c")[0]["achievements"]).alias("n"), X.payload_companies(F.col("c"))[0]["period_start"].alias("stored"))


@query(
    "q65",
    """WITH t AS (SELECT p_partkey, '- Roles: ' || p_name || ', ' || p_type || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '- Locations: ' || p_brand || chr(10) ELSE '' END || '- Remote required: ' || CASE WHEN p_partkey % 3 = 0 THEN 'yes' ELSE 'no' END ||
      CASE WHEN p_partkey % 5 = 0 THEN chr(10) || '- Minimum salary: ¥' || format('{:,}', p_size * 100000) || '/year' || chr(10) || '- Target start: 2024-05-06' ELSE '' END AS prefs FROM part)
    SELECT p_partkey, md5('Wishes:' || chr(10) || prefs || chr(10) || chr(10) || 'Rate from 0 to 100 how the posting below meets them.' || chr(10) || chr(10) || '<job>' || chr(10) || '{' || p_name || '}' || chr(10) || '</job>' || chr(10)) AS prompt,
      CASE WHEN p_partkey % 4 = 0 THEN 'gone' WHEN p_partkey % 4 = 1 THEN 'Last fetched a' WHEN p_partkey % 4 = 2 THEN 'Fetched b' ELSE 'Waiting for first fetch…' END AS line FROM t JOIN part USING (p_partkey)""",
)
def q65(spark, d):
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    some = k % 5 == 0
    prefs = N.preference_text(
        F.array("p_name", "p_type"), F.when(k % 2 == 0, F.array("p_brand")).otherwise(none), k % 3 == 0, none, F.when(some, F.col("p_size").cast("long") * 100_000), F.when(some, F.lit("2024-05-06").cast("date"))
    )
    job = F.concat(F.lit("{"), "p_name", F.lit("}"))
    line = N.status_line(F.when(k % 4 == 0, "gone").otherwise(""), F.when(k % 4 == 1, F.lit("a")), F.when(k % 4 < 3, F.lit("b")))
    return table(spark, d, "part").select("p_partkey", F.md5(N.prompt(prefs, job, "Wishes:\n{preferences}\n\nRate from 0 to 100 how the posting below meets them.\n\n<job>\n{job}\n</job>\n")).alias("prompt"), line.alias("line"))


@query("q66", "SELECT event_id FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 50")
def q66(spark, d):
    """The fifty latest events."""
    return P.newest_first(table(spark, d, "events").select("event_id", "ts"), "ts", [F.desc("event_id")]).limit(50).select("event_id")


@query(
    "q67",
    r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unsupported file' WHEN length(t) < 40 THEN 'too little text' END AS error, CASE WHEN doc_id % 5 > 0 AND length(t) >= 40 THEN md5(left(t, 60000)) END AS digest FROM t""",
)
def q67(spark, d):
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".exe").otherwise(".TXT"))
    files = table(spark, d, "documents").select(name.alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return L.extract_texts(files).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "error", F.md5("text").alias("digest"))


@query("q68", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01'")
def q68(spark, d):
    return G.unexpired(table(spark, d, "orders"), "o_orderdate", F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query(
    "q69",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'no "credit" ' || doc_id WHEN 1 THEN 'plain' ELSE 'HTTP 403' END AS message FROM documents""",
)
def q69(spark, d):
    k = F.col("doc_id")
    body = F.when(k % 4 == 0, F.concat(F.lit('{"error": {"message": "no \\"credit\\" '), k.cast("string"), F.lit('"}}'))).when(k % 4 == 1, F.lit('{"error": "x"}')).when(k % 4 == 2, F.lit("{broken"))
    return table(spark, d, "documents").select("doc_id", G.status_message(body, F.lit(403), F.when(k % 4 == 1, "plain").otherwise("")).alias("message"))


@query(
    "q70",
    """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 7 = 0 THEN 'company_name' END, CASE WHEN p_partkey % 9 = 0 THEN 'location_length' END, CASE WHEN p_partkey % 4 = 0 THEN 'salary_min' END,
      CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 = 0 AND p_partkey % 5 > 0 THEN 'salary_order' END], lambda x: x IS NOT NULL), ',') AS broken FROM part
    WHERE p_partkey % 7 = 0 OR p_partkey % 9 = 0 OR p_partkey % 4 = 0 OR (p_partkey % 3 = 0 AND p_partkey % 5 > 0)""",
)
def q70(spark, d):
    """Postings typed in by hand that break rules, with the rules' names."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    null = F.lit(None).cast("string")
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(k % 7 == 0, "").otherwise(F.col("p_brand")).alias("company_name"), F.col("p_name").alias("title"), F.when(k % 9 == 0, F.repeat(F.lit("x"), 301)).alias("location"),
        F.when(k % 4 == 0, -size).otherwise(size).alias("salary_min"), F.when(k % 5 > 0, F.when(k % 3 == 0, size - 1).otherwise(size)).alias("salary_max"), null.alias("employment_type"), F.col("p_name").alias("description"), null.alias("apply_url"),
    )
    return G.quarantined(rows, G.posting_rules())[1].select("p_partkey", F.array_join("broken", ",").alias("broken"))


@query(
    "q71",
    """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'url' END, CASE WHEN o_orderkey % 6 = 0 THEN 'interval' END, CASE WHEN o_orderkey % 7 = 0 THEN 'state' END,
      CASE WHEN o_orderkey % 4 IN (0, 3) THEN 'one_source' END, CASE WHEN o_orderkey % 4 = 2 THEN 'text_length' END, CASE WHEN o_orderkey % 8 > 5 THEN 'code' END, CASE WHEN o_orderkey % 9 = 8 THEN 'score' END], lambda x: x IS NOT NULL), ',') AS broken FROM orders""",
)
def q71(spark, d):
    """Sources, uploads, codes and scores against their rules."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 5 == 0, "ftp://x").otherwise(" https://x.jp/jobs ").alias("url"), F.lit(None).cast("string").alias("label"), F.when(k % 6 == 0, 169).otherwise(F.when(k % 2 == 0, 168)).alias("fetch_interval_hours"),
        F.when(k % 7 == 0, "gone").otherwise("paused").alias("status"), F.when(k % 4 == 1, "k").when(k % 4 == 3, "k").alias("source_key"), F.when(k % 4 == 2, "short").when(k % 4 == 3, F.repeat(F.lit("long "), 9)).alias("raw_text"),
        F.when(k % 8 > 5, "12345a").otherwise("012345").alias("code"), F.when(k % 9 == 8, 101).otherwise(100).alias("score"),
    )
    rules = G.source_rules() | {"state": G.state_rule("status", "source_status")} | G.document_rules() | G.code_rules() | G.outcome_rules()
    return rows.select("o_orderkey", F.array_join(G.failed_rules(**rules), ",").alias("broken"))


@query(
    "q72",
    """SELECT c_custkey, sha256(c_name) AS token, CASE WHEN c_custkey % 2 = 0 THEN 'manual' ELSE 'ats' END AS source_type, c_custkey % 3 = 0 AS has_vendor, c_custkey % 5 = 0 AS has_match FROM customer""",
)
def q72(spark, d):
    k = F.col("c_custkey")
    match = F.when(k % 5 == 0, F.struct(F.lit(80).alias("score")))
    document = D.build_payload([F.col("c_name").alias("title"), F.lit(None).cast("string").alias("location")], F.when(k % 2 == 0, "manual").otherwise("ats"), F.when(k % 3 == 0, "v1"), match)
    v = F.parse_json(document)
    has = lambda path: F.variant_get(v, path, "variant").isNotNull()
    return table(spark, d, "customer").select("c_custkey", X.hash_token(F.col("c_name")).alias("token"), D.source_type_of(document).alias("source_type"), has("$.ats_vendor").alias("has_vendor"), has("$.match").alias("has_match"))


@query(
    "q73",
    """WITH v AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN turn % 2 = 0 THEN 'e' END AS error, text FROM conversations),
    e AS (SELECT conv_id, turn, arg_max(note, k) AS note FROM (SELECT conv_id, turn, 'a' AS note, 1 AS k FROM v WHERE turn % 3 = 0 UNION ALL SELECT conv_id, turn, 'b', 2 FROM v WHERE turn % 6 = 0) GROUP BY conv_id, turn)
    SELECT conv_id, turn, coalesce(e.note, md5(text)) AS structured, CASE WHEN e.note IS NULL THEN status ELSE 'ready' END AS status, CASE WHEN e.note IS NULL THEN error END AS error FROM v LEFT JOIN e USING (conv_id, turn)""",
)
def q73(spark, d):
    t = F.col("turn")
    c = table(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    versions = c.select("key", F.md5("text").alias("structured"), F.when(t % 2 == 0, "failed").otherwise("ready").alias("status"), F.when(t % 2 == 0, "e").alias("error"))
    edits = c.filter("turn % 3 = 0").select("key", F.explode(F.array(F.struct(F.lit(1).alias("at"), F.lit("a").alias("s")), F.struct(F.lit(2).alias("at"), F.lit("b").alias("s")))).alias("x"), "turn")
    edits = edits.filter("x.at = 1 OR turn % 6 = 0").select("key", "x.at", F.col("x.s").alias("structured"))
    return D.edit_documents(versions, edits, "key", ["at"]).select("key.conv_id", "key.turn", "structured", "status", "error")


@query(
    "q74",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false ELSE true END AS same FROM documents""",
)
def q74(spark, d):
    """Which changes count as content: text does, the order of skills and the apply link don't, a known false against unknown does."""
    k = F.col("doc_id")
    base = {n: F.lit(None).cast("string") for n in X.CONTENT_FIELDS} | {"title": F.col("lang"), "description": F.coalesce("text", F.lit("")), "remote": F.lit(None).cast("boolean")}
    skills = {"required_skills": F.array(F.lit("b"), F.lit("a")), "preferred_skills": F.array().cast("array<string>"), "apply_url": F.lit("x")}
    one = base | skills
    two = one | {
        "description": F.when(k % 5 == 0, F.concat(one["description"], F.lit("."))).otherwise(one["description"]), "required_skills": F.when(k % 5 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(skills["required_skills"]),
        "apply_url": F.when(k % 5 == 2, "y").otherwise("x"), "remote": F.when(k % 5 == 3, F.lit(False)),
    }
    struct = lambda fields: F.struct(*(c.alias(n) for n, c in fields.items()))
    return table(spark, d, "documents").select("doc_id", struct(one).alias("one"), struct(two).alias("two")).select("doc_id", (X.posting_hash(F.col("one")) == X.posting_hash(F.col("two"))).alias("same"))


@query("q75", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS known FROM part")
def q75(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 4).alias("user_id"), F.col("p_partkey").cast("string").alias("dedup_key"), "p_partkey", "p_size")
    return C.attach_posting(p.select("user_id", "dedup_key", "p_partkey"), p.filter("p_partkey % 3 = 0").select("user_id", "dedup_key", "p_size")).select("p_partkey", F.col("posting.p_size").alias("known"))


@query("q76", "SELECT conv_id, count(*) + 1 AS version_no FROM conversations GROUP BY conv_id")
def q76(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn")
    numbered = C.number_versions(turns, turns.limit(0).withColumnRenamed("turn", "version_no"), "conv_id", ["turn"])
    return C.next_version(numbered.select("conv_id", "version_no"), "conv_id")


# --- incremental ingest

_STATUS = """CASE WHEN doc_id % 10 <> 0 AND (doc_id % 7 <> 0 OR text IS NULL) THEN 'unchanged' WHEN user_id % 4 = 3 THEN 'kept' WHEN doc_id % 6 = 1 THEN 'filtered' WHEN doc_id % 13 = 0 THEN 'scoring_failed'
  WHEN doc_id % 17 = 0 AND user_id = 2 THEN 'unscored' WHEN doc_id % 101 < 30 THEN 'below_threshold' ELSE 'kept' END"""
_HELD = f"""WITH b AS (SELECT doc_id, text, coalesce(source, 'none') AS source_id, length(coalesce(source, 'none')) % 5 AS user_id FROM documents),
    d AS (SELECT *, doc_id % 11 <> 0 AS listed, {_STATUS} AS st FROM b),
    r AS (SELECT source_id, user_id <> 1 AND NOT bool_or(listed AND st = 'unscored') AS complete FROM d GROUP BY source_id, user_id),
    s AS (SELECT d.*, complete, doc_id % 10 <> 0 AS held, CASE WHEN listed AND st = 'kept' THEN 'written' WHEN listed AND st IN ('unchanged', 'scoring_failed') THEN 'stays' WHEN complete THEN 'goes' ELSE 'stays' END AS fate FROM d JOIN r USING (source_id))"""


def ingest_inputs(spark, d):
    """Stored tables, fetched postings, preferences and landed outcomes over documents: sources hold nine tenths of theirs, some changed, some gone."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("source_id"))
    docs = docs.withColumn("user_id", F.length("source_id") % 5)
    k, null = F.col("doc_id"), lambda kind: F.lit(None).cast(kind)
    fetched = docs.select(
        "source_id", "user_id", k.cast("string").alias("external_id"), F.concat(F.lit("http://x.jp/"), k.cast("string")).alias("url"), F.lit("ats").alias("source_type"), F.lit("v1").alias("ats_vendor"),
        F.lit("Data Engineer").alias("title"), F.col("source_id").alias("company_name"), null("string").alias("location"), null("boolean").alias("remote"), F.when(k % 6 == 1, "Contract").alias("employment_type"),
        null("long").alias("salary_min"), null("long").alias("salary_max"), F.array().cast("array<string>").alias("required_skills"), F.array().cast("array<string>").alias("preferred_skills"), F.col("text").alias("description"),
        null("string").alias("apply_url"), F.array().cast("array<string>").alias("needs_review"), "doc_id",
    )
    old = fetched.withColumn("description", F.when(k % 7 == 0, F.concat("description", F.lit(" old"))).otherwise(F.col("description")))
    jobs = old.filter("doc_id % 10 <> 0").select(
        "source_id", "user_id", X.identity(F.col("external_id"), F.col("url")).alias("identity"), "external_id", "url", X.posting_key(F.col("ats_vendor"), F.col("external_id"), F.col("company_name"), F.col("title"), F.col("location")).alias("dedup_key"),
        X.posting_hash(F.struct(*I.FIELDS)).alias("hash"), F.lit("{}").alias("structured"), F.lit(50).alias("match_score"), F.lit(1).alias("first_seen"), F.lit(1).alias("last_seen"),
    )
    postings = jobs.select("user_id", "dedup_key", F.lit("c").alias("company_name"), F.lit("c").alias("company_name_normalized"), F.lit("t").alias("canonical_title"), null("string").alias("location_normalized"), "structured", "match_score")
    sources = docs.select("source_id", "user_id").distinct().select(
        "source_id", "user_id", F.lit("active").alias("status"), F.lit(1).cast("long").alias("consecutive_failures"), null("string").alias("robots_state"), null("string").alias("last_error"), null("string").alias("source_type"),
        null("string").alias("ats_vendor"), *(null("int").alias(c) for c in ("robots_checked_at", "last_fetched_at", "last_success_at")),
    )
    types, none = F.array(F.lit("full_time")), F.array().cast("array<string>")
    prefs = docs.select("user_id").distinct().filter("user_id % 4 <> 3").select("user_id", types.alias("employment_types"), F.lit(False).alias("remote_required"), none.alias("locations"), F.array(F.lit("data engineer")).alias("desired_roles"))
    unscored = (k % 17 == 0) & (F.col("user_id") == 2)
    body = F.when(unscored & (k % 13 != 0), F.lit('{"error": {"message": "no credit"}}')).when(k % 13 == 0, F.lit('{"score": 900}')).otherwise(F.concat(F.lit('{"score": '), (k % 101).cast("string"), F.lit("}")))
    outcomes = docs.select("source_id", k.cast("string").alias("identity"), F.when(unscored & (k % 13 != 0), 402).otherwise(200).alias("status"), body.alias("body"))
    return I.Snapshot(jobs, postings, sources), fetched.filter("doc_id % 11 <> 0"), prefs, outcomes


def runs_of(sources):
    """One run a source; those of users 1 end with a fetch error behind their last page."""
    null = F.lit(None).cast("string")
    return sources.select("source_id", F.lit(1).alias("run"), F.lit(2).alias("at"), F.when(F.col("user_id") == 1, "timeout").alias("error"), F.lit("ats").alias("route"), F.lit("v1").alias("vendor"), F.lit("allowed").alias("robots_state"))


@query(
    "q77",
    f"""{_HELD} SELECT doc_id, CASE WHEN fate = 'written' AND user_id % 4 <> 3 THEN CAST(doc_id % 101 AS INTEGER) WHEN fate = 'written' THEN NULL ELSE 50 END AS match_score, CASE WHEN held THEN 1 ELSE 2 END AS first_seen,
    CASE WHEN fate = 'written' THEN 2 ELSE 1 END AS last_seen FROM s WHERE fate = 'written' OR (held AND fate = 'stays')""",
)
def q77(spark, d):
    """Jobs after one batch: written, unchanged, gone, or left alone because their run was not complete."""
    held, fetched, prefs, outcomes = ingest_inputs(spark, d)
    after, _ = I.ingest_batch(held, fetched, runs_of(held.sources), prefs, I.landed_scorer(outcomes), F.lit(2))
    return after.jobs.select(F.col("external_id").cast("long").alias("doc_id"), "match_score", "first_seen", "last_seen")


@query(
    "q78",
    f"""{_HELD} SELECT source_id, CAST(CASE WHEN bool_and(complete) THEN 0 ELSE 2 END AS BIGINT) AS consecutive_failures, count(*) FILTER (WHERE listed) AS fetched,
    count(*) FILTER (WHERE listed AND st = 'unchanged') AS unchanged, count(*) FILTER (WHERE listed AND st = 'filtered') AS filtered, count(*) FILTER (WHERE listed AND st = 'below_threshold') AS below_threshold,
    count(*) FILTER (WHERE listed AND st = 'scoring_failed') AS scoring_failed, count(*) FILTER (WHERE listed AND st = 'kept') AS saved, count(*) FILTER (WHERE fate = 'written' OR held AND fate = 'stays') AS postings FROM s GROUP BY source_id""",
)
def q78(spark, d):
    """A run's counters, its outcome on the source, and the postings that are left."""
    held, fetched, prefs, outcomes = ingest_inputs(spark, d)
    after, statuses = I.ingest_batch(held, fetched, runs_of(held.sources), prefs, I.landed_scorer(outcomes), F.lit(2))
    names = ["unchanged", "filtered", "below_threshold", "scoring_failed", "kept"]
    counters = C.run_counters(statuses, ["source_id"], "status", names)
    left = after.postings.join(after.jobs.select("user_id", "dedup_key", "source_id").distinct(), ["user_id", "dedup_key"]).groupBy("source_id").agg(F.count(F.lit(1)).alias("postings"))
    out = after.sources.select("source_id", "consecutive_failures").join(counters, "source_id", "left").join(left, "source_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("source_id", "consecutive_failures", zero("fetched"), *(zero(n) for n in names[:-1]), F.coalesce("kept", F.lit(0)).alias("saved"), zero("postings"))


@query("s6", f"{_HELD} SELECT doc_id, st AS status FROM s WHERE listed")
def s6(spark, d):
    """The same by foreachBatch over landed files, on snapshots in the shared folder."""
    held, fetched, prefs, outcomes = ingest_inputs(spark, d)
    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    store = I.SnapshotStore(spark, f"{base}/store")
    store.write(-1, held)
    fetched.write.parquet(f"{base}/landed")
    landed = spark.readStream.schema(fetched.schema).option("maxFilesPerTrigger", 1000).parquet(f"{base}/landed")
    statuses = R.ingest_stream(landed, store, lambda batch, n: runs_of(held.sources.join(batch.select("source_id").distinct(), "source_id", "left_semi")), prefs, I.landed_scorer(outcomes), lambda n: F.lit(2 + n))
    return statuses.select(F.col("identity").cast("long").alias("doc_id"), "status")


@query(
    "s8",
    ORACLE_SQL["q77"],
)
def s8(spark, d):
    """The stored jobs after a stream of several batches, one landed file each; a batch rewrites the buckets of its own sources."""
    held, fetched, prefs, outcomes = ingest_inputs(spark, d)
    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    store = I.SnapshotStore(spark, f"{base}/store")
    store.write(-1, held)
    # a source's listing is in one file
    placed = fetched.withColumn("_file", F.pmod(F.xxhash64("source_id"), F.lit(6)).cast("int"))
    placed.repartitionById(6, "_file").drop("_file").write.parquet(f"{base}/landed")
    landed = spark.readStream.schema(fetched.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landed")
    R.ingest_stream(landed, store, lambda batch, n: runs_of(held.sources.join(batch.select("source_id").distinct(), "source_id", "left_semi")), prefs, I.landed_scorer(outcomes), lambda n: F.lit(2))
    after = store.read(store.batches()[-1])
    return after.jobs.select(F.col("external_id").cast("long").alias("doc_id"), "match_score", "first_seen", "last_seen")


@query("s7", _ATTEMPTS.replace("SELECT event_id, user_id, result FROM f", "SELECT event_id, result FROM f"))
def s7(spark, d):
    log = attempts(R.read_events(spark, f"{d}/events.parquet"))
    return R.drained(R.attempts_stream(log, "user_id", 5, 6 * 86400, buckets=BUCKETS)).filter("NOT late").drop("batch", "late")


def _late_sql(sql: str, keys: str, columns: str) -> str:
    """A rule's SQL over the rows that are in time, and the late ones of the sixth file: those before a row of their key or an hour before the others' end."""
    nulls = "".join(f"NULL AS {c}, " for c in columns.split(", ") if c)
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    return f"""WITH known AS (SELECT *, event_id % 97 = 0 AS held FROM events WHERE {known}),
    marked AS (SELECT *, held AND (epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM known WHERE NOT held) - 3600000
      OR coalesce(max(CASE WHEN held THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1) AS late FROM known),
    judged AS (SELECT * FROM marked WHERE NOT late), r AS ({sql.replace("FROM events", "FROM judged")})
    SELECT event_id, {columns + ", " if columns else ""}false AS late FROM r UNION ALL SELECT event_id, {nulls}true FROM marked WHERE late"""


def landed_late(spark, d: str, base: str):
    """Events as a stream of six files, one a batch: five in time order, and what was held back in the last."""
    events = table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(us), F.max(us)).first()
    held = F.col("event_id") % 97 == 0
    place = F.when(held, 5).otherwise(F.floor((us - F.lit(low or 0)) * 5 / F.lit((high or 0) - (low or 0) + 1)))
    for k in range(6):
        events.filter(place == k).repartition(1).write.mode("append").parquet(f"{base}/landed")
    return R.read_events(spark, f"{base}/landed", 1)


def _late_query(name: str, sql: str, keys: str, columns: str, rule) -> None:
    def run(spark, d):
        base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
        return R.drained(rule(landed_late(spark, d, base)), base=base).drop("batch")

    run.__doc__ = f"{name}: six batches with late rows; those are told apart and change nothing."
    query(name, _late_sql(sql, keys, columns))(run)


_late_query("s10", ORACLE_SQL["q24"], "user_id, event_type", "", lambda e: R.dedupe_stream(e, ["user_id", "event_type"], 86400, buckets=BUCKETS))
_late_query("s11", ORACLE_SQL["s3"], "user_id", "streak, stopped", lambda e: R.failure_stream(e.withColumn("failed", F.col("event_type") == "error"), "user_id", "failed", buckets=BUCKETS))
_late_query("s12", ORACLE_SQL["s4"], "user_id", "alive", lambda e: R.session_stream(e, "user_id", 21600, 86400, buckets=BUCKETS))
_late_query("s13", ORACLE_SQL["s7"], "user_id", "result", lambda e: R.attempts_stream(attempts(e), "user_id", 5, 6 * 86400, buckets=BUCKETS))


def _laid(layout: B.Layout, rows):
    return layout.write(rows, f"{shared_folder(rows.sparkSession)}/table-{uuid.uuid4().hex}")


@query("q80", ORACLE_SQL["q01"])
def q80(spark, d):
    """q01 on a stored table: the customer's folder alone is read."""
    layout = B.Layout(("o_orderkey",), 8, user="o_custkey", folders=16)
    return layout.scoped(_laid(layout, table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")), 42).select("o_orderkey", "o_totalprice")


@query("q81", ORACLE_SQL["q03"])
def q81(spark, d):
    """q03 on stored hashes: the batch goes to the buckets of what is stored."""
    docs = table(spark, d, "documents")
    content = lambda t: X.content_hash(F.struct(F.col("source").alias("company"), t.alias("title"), F.col("lang").alias("location"), F.array_sort(F.array("lang", "source")).alias("skills")))
    old = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    known = _laid(B.Layout(("doc_id",), 8), docs.filter("doc_id % 10 <> 0").select("doc_id", content(old).alias("hash")))
    now = docs.filter("doc_id % 11 <> 0").select("doc_id", content(F.col("text")).alias("now_hash"))
    return G.attach_known_hash(now, known, ["doc_id"]).select("doc_id", G.diff_status(F.col("now_hash"), F.col("known_hash")).alias("status"))


@query("q82", ORACLE_SQL["q13"])
def q82(spark, d):
    """q13 on stored tables: distinct identities and those that survived meet without an exchange of either."""
    layout = B.Layout(("l_suppkey", "l_partkey"), 8)
    items = table(spark, d, "lineitem")
    held = _laid(layout, items.select("l_suppkey", "l_partkey")).distinct()
    survivors = _laid(layout, items.filter("l_quantity > 25").select("l_suppkey", "l_partkey"))
    complete = table(spark, d, "supplier").filter("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return B.stale_stored(held, survivors, complete, ["l_suppkey", "l_partkey"], "l_suppkey").select("l_suppkey", "l_partkey")
