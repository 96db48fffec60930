"""As-of lookups, prefix joins and boards against plain loops, with odd rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from jobloom.operators import asof as A
from jobloom.operators import gates as G
from jobloom.plans.queries import QUERIES
from jobloom.sources import payloads as L

START = datetime(2024, 1, 1)


def test_last_version_of_each_request(spark):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot", "hot", "hot", "cold", None])
    at = lambda: None if rng.random() < 0.05 else START + timedelta(seconds=rng.randrange(500))
    asked = [(i // 2, key(), at(), "x") for i in range(300)] + [(7, "hot", START, "x")] * 2
    given = [(i, key(), at(), "y") for i in range(40)]
    requests = spark.createDataFrame(asked, "id long, host string, at timestamp, note string")
    versions = spark.createDataFrame(given, "version long, host string, since timestamp, note string")
    got = A.last_before(requests, versions, "host", "at", "since", "id", "version", 60).collect()
    want = []
    for i, k, t, note in asked:
        seen = [(s, v) for v, h, s, _ in given if None not in (h, s, k, t) and h == k and s <= t]
        best = max(seen, default=None)
        want.append((i, k, t, note, best[1] if best and t - best[0] <= timedelta(seconds=60) else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert A.last_before(requests, versions.limit(0), "host", "at", "since", "id", "version", 60).filter("version IS NOT NULL").count() == 0
    assert A.last_before(requests.limit(0), versions, "host", "at", "since", "id", "version").count() == 0


def test_longest_of_many_prefixes(spark):
    rules = spark.range(100_000).select(F.lit("h").alias("host"), F.concat(F.lit("/"), F.col("id").cast("string")).alias("prefix"), (F.col("id") % 3 == 0).alias("allow"))
    more = spark.createDataFrame([("h", "/12", True), ("g", "/", False), ("g", "/é", True), ("h", "", False), ("h", None, False), (None, "/", False)], "host string, prefix string, allow boolean")
    rules = rules.unionByName(more)
    rows = [("h", "/12"), ("h", "/12x"), ("h", "/777777"), ("h", "/"), ("g", "/éa"), ("g", "/e"), ("g", None), (None, "/"), ("h", "/12"), ("h", ""), ("k", "/1" * 4000)]
    urls = spark.createDataFrame(rows, "host string, path string")
    found = A.longest_prefix(urls, rules, "host", "path", "prefix", F.col("allow"), "allow")
    held = [tuple(r) for r in rules.collect()]

    def best(host, path):
        fits = [(len(p), a) for h, p, a in held if p and h is not None and h == host and path is not None and path.startswith(p)]
        return max(fits, default=(0, None))[1]

    assert sorted(map(tuple, found.collect()), key=str) == sorted(((h, p, best(h, p)) for h, p in rows), key=str)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rules_change_between_requests(spark):
    files = spark.createDataFrame(
        [(1, "h", START, 200, "User-agent: *\nDisallow: /a"), (2, "h", START + timedelta(hours=1), 404, None), (3, "h", START + timedelta(hours=2), 503, None), (4, "h", START + timedelta(hours=3), 200, "User-agent: *\nDisallow: /b\nCrawl-delay: 4")],
        "file_id long, host string, fetched_at timestamp, status int, body string",
    )
    hours = [-1, 0, 0.5, 1, 2.5, 3, 27, 27.1]
    requests = spark.createDataFrame([(i, "h", p, START + timedelta(hours=h)) for i, h in enumerate(hours) for p in ("/a", "/b")], "request_id long, host string, path string, at timestamp")
    got = {(r["request_id"], r["path"]): (r["file_id"], r["decision"], r["robots_state"], r["crawl_delay"]) for r in G.crawl_decision_as_of(requests, files, "bot").collect()}
    none, read1, gone, bad = (None, "allowed", "unknown", None), (1, "disallowed", "allowed", None), (2, "allowed", "allowed", None), (3, "allowed", "unknown", None)
    assert [got[i, "/a"] for i in range(8)] == [none, read1, read1, gone, bad, (4, "allowed", "allowed", 4.0), (4, "allowed", "allowed", 4.0), none]
    assert [got[i, "/b"] for i in range(8)] == [none, (1, "allowed", "allowed", None), (1, "allowed", "allowed", None), gone, bad, (4, "disallowed", "allowed", 4.0), (4, "disallowed", "allowed", 4.0), none]


def test_all_boards_in_one_scan(spark):
    plan = lambda: QUERIES["q10"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan().count("FileScan") == 1
    L.register_board("nested", L.Board("$.data.jobs", ("$.link",), "$.name", "$.where", "$.text"))
    try:
        assert plan().count("FileScan") == 1
        landed = spark.createDataFrame(
            [
                ("s", "nested", "b", '{"data": {"jobs": [{"id": 5, "name": " ", "link": "u", "text": "<p>x</p>"}]}}'), ("s", "nested", "b", '{"jobs": [{"id": 6}]}'), ("s", "unknown", "b", '{"jobs": [{"id": 7}]}'), ("s", None, "b", "[]"),
                ("s", "list", "b", '[{"id": "l", "text": "T", "descriptionPlain": " d ", "description": "<p>no</p>", "workplaceType": "remote"}]'), ("s", "object", "b", '{"jobs": [{"id": 8, "company_name": " "}]}'), ("s", "paid", "b", None),
            ],
            "source_id string, vendor string, board_id string, body string",
        )
        got = {r["external_id"]: (r["url"], r["title"], r["company_name"], r["remote"], r["description"], r["needs_review"]) for r in L.normalise_boards(landed).collect()}
        assert got == {
            "5": ("u", "(untitled)", "b", None, "x", ["salary"]), "l": (None, "T", "b", True, "d", ["salary"]), "8": ("board:b", "(untitled)", "b", None, "", ["salary", "description"]),
        }
        assert L.bad_payloads(landed.filter("vendor = 'nested'")).count() == 1
    finally:
        L._BOARDS.pop("nested")
