"""Values that the test tables don't hold: full-width text, nested graphs, translated addresses, ids of other sources, odd rows of stored tables."""

import pytest
from pyspark.sql import functions as F

from jobloom.functions import text as X
from jobloom.operators import clustering as C
from jobloom.operators import gates as G
from jobloom.operators import pacing as P
from jobloom.operators import shared
from jobloom.operators import snapshots as D
from jobloom.operators import state as S
from jobloom.sources import payloads as L


def column(spark, rows, schema, c):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(c).collect()]


def test_full_width_preferences_and_titles(spark):
    rows = [("Ｆｕｌｌ－ｔｉｍｅ", ["full_time"], False), ("Full-time", ["ＦＵＬＬ　ＴＩＭＥ"], False), ("Ｆｕｌｌ　ｔｉｍｅ", ["full_time"], True), ("x", None, False), ("x", [None, " "], False)]
    assert column(spark, rows, "t string, w array<string>, e boolean", G.type_mismatch(F.col("t"), F.col("w"))) == [r[2] for r in rows]
    roles = F.array(F.lit("Data Engineer"))
    assert column(spark, [("Ｄａｔａ　Ｅｎｇｉｎｅｅｒ",), ("Sales",), (None,)], "t string", G.title_rejected(F.col("t"), roles, "strict")) == [False, True, True]
    rows = [(False, True, "ＴＯＫＹＯ, JP", ["tokyo"], False), (False, True, "Straße", ["STRASSE"], False), (False, True, "Osaka", ["Ｏｓａｋａ"], False), (False, True, "Osaka", [""], True)]
    assert column(spark, rows, "r boolean, q boolean, l string, w array<string>, e boolean", G.remote_mismatch(F.col("r"), F.col("q"), F.col("l"), F.col("w"))) == [r[4] for r in rows]


def test_folding_equals_the_standard_one(spark):
    import unicodedata

    texts = ["Straße", "ÉCOLE œuvre", "ＡＢＣ", "ﬁ", "µ", "İ", "Ÿ", "½ ª º", "é", "“q”–€", "", "ſ", None]
    want = [None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in texts]
    assert column(spark, [(t,) for t in texts], "t string", X.folded(F.col("t"))) == want


def test_plain_texts_stay_out_of_python(spark):
    plan = spark.createDataFrame([("a",)], "t string").select(X.normalize_text(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "fold_unicode(CASE WHEN" in plan


def test_graph_of_one_object_and_nested_lists(spark):
    script = '<script type="application/ld+json">{}</script>'
    pages = [(1, "http://h/p", script.format('{"@graph": {"@type": "JobPosting", "title": "A", "url": "/j"}}')), (2, "http://h/p", script.format('[[{"@type": "JobPosting", "title": {"name": "B"}, "url": "/k"}]]'))]
    got = {(r["id"], r["url"], r["title"]) for r in L.extract_job_postings(spark.createDataFrame(pages, "id int, url string, html string"), "id", "url", "html").collect()}
    assert got == {(1, "http://h/j", "A"), (2, "http://h/k", "B")}


def test_translated_addresses(spark):
    rows = [("64:ff9b:1::808:808", False), ("64:ff9b:1::a00:1", True), ("64:ff9b::808:808", False)]
    assert column(spark, rows, "i string, e boolean", X.blocked_v6("i")) == [r[1] for r in rows]


def test_masks_and_months(spark):
    assert column(spark, [("ann@x@y.jp",), ("@x",), ("plain",), (None,)], "e string", X.mask_email(F.col("e"))) == ["a***@x@y.jp", "***@x", "plain", None]
    assert column(spark, [(" 2021-4 ",), (None,), ("",), ("2021-04-01",)], "m string", X.to_month(F.col("m"))) == ["2021-04", "", "", "2021-04"]


def test_matches_stay_inside_their_source(spark):
    batch = spark.createDataFrame([("a", "1", "u1"), ("b", "1", "u9"), (None, "1", "u1")], "source string, external_id string, url string")
    held = spark.createDataFrame([("a", "1", "u2", 10), ("b", "2", "u9", 20), (None, None, "u1", 30)], "source string, external_id string, url string, target int")
    got = {r["source"]: r["target"] for r in C.match_existing(batch, held, ["external_id", "url"], "target", ["source"]).collect()}
    assert got == {"a": 10, "b": 20, None: 30}


def test_folds_keep_repeats_and_leave_out_nobody(spark):
    log = spark.createDataFrame([("a", 0.0, 1), ("a", 0.0, 2), ("a", 9.0, 3), ("a", 10.0, 4), ("a", 30.0, 5), (None, 0.0, 6)], "k string, s double, i int")
    assert sorted(r["i"] for r in S.dedupe_ttl(log, ["k"], "s", "i", 10.0).collect()) == [1, 4, 5]
    got = {r["i"]: (r["alive"], r["expires"]) for r in S.sliding_sessions(log, "k", "s", "i", 9.5, 10.0).collect()}
    assert got == {1: (False, 10.0), 2: (True, 10.0), 3: (True, 10.0), 4: (False, 20.0), 5: (False, 40.0)}
    assert S.dedupe_ttl(log.limit(0), ["k"], "s", "i", 1.0).count() == 0 == S.sliding_sessions(log.limit(0), "k", "s", "i", 1.0, 2.0).count()


@pytest.mark.parametrize("seed", range(3))
def test_folds_equal_plain_loops(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(rng.choice("abc"), float(rng.randint(0, 60)), i) for i in range(120)]
    log = spark.createDataFrame(rows, "k string, s double, i int")
    kept, sessions, last, end, touched = set(), {}, {}, {}, {}
    for k, s, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if k not in last or s - last[k] >= 5:
            last[k] = s
            kept.add(i)
        alive = k in end and s < end[k]
        if not alive or s - touched[k] >= 2:
            touched[k], end[k] = s, s + 7
        sessions[i] = (alive, end[k])
    assert {r["i"] for r in S.dedupe_ttl(log, ["k"], "s", "i", 5.0).collect()} == kept
    assert {r["i"]: (r["alive"], r["expires"]) for r in S.sliding_sessions(log, "k", "s", "i", 2.0, 7.0).collect()} == sessions


@pytest.mark.parametrize("name", ["q24", "q26", "q27", "q21"])
def test_no_python_and_no_sort_of_all_rows_in_one_task(spark, name):
    from jobloom.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "SinglePartition" not in plan


def test_last_writes_defaults_and_patches(spark):
    commands = spark.createDataFrame([(1, 1, ["a"], True), (1, 2, None, None)], "user_id int, at int, desired_roles array<string>, remote_required boolean")
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    got = {r["user_id"]: (r["desired_roles"], r["remote_required"]) for r in D.with_default_preferences(users, D.last_writes(commands, "user_id", ["at"])).collect()}
    assert got == {1: (None, None), 2: ([], False)}
    assert D.fold_patches(commands, "user_id", ["at"], ["desired_roles", "remote_required"]).collect()[0][1:] == (["a"], True)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())


def test_sources_stop_and_recover(spark):
    sources = spark.createDataFrame(
        [("a", "active", 4, None, None, None, None, None, None, None), ("b", "active", 4, None, "old", None, None, None, None, 1), ("c", "paused", 2, "allowed", "kept", None, None, None, None, None)],
        "source_id string, status string, consecutive_failures int, robots_state string, last_error string, source_type string, ats_vendor string, robots_checked_at int, last_fetched_at int, last_success_at int",
    )
    runs = spark.createDataFrame([("a", 1, 10, "e", None, None, "unknown"), ("b", 1, 10, "e", "ats", "v", "allowed"), ("b", 2, 11, None, "json_ld", None, "allowed")], "source_id string, run int, at int, error string, route string, vendor string, robots_state string")
    got = {r["source_id"]: r for r in D.record_outcomes(sources, runs, ["run"]).collect()}
    assert (got["a"]["status"], got["a"]["consecutive_failures"], got["a"]["last_success_at"]) == ("error", 5, None)
    assert (got["b"]["status"], got["b"]["consecutive_failures"], got["b"]["last_error"], got["b"]["last_success_at"], got["b"]["source_type"], got["b"]["ats_vendor"]) == ("active", 0, None, 11, "json_ld", None)
    assert (got["c"]["consecutive_failures"], got["c"]["last_error"]) == (2, "kept")


def test_ranks_of_an_empty_table_and_ties(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 5)], "k int, s int")
    assert [r["k"] for r in P.ranked(rows, "s", [F.desc("k")]).orderBy("rank").collect()] == [3, 1, 2]
    assert P.ranked(rows.limit(0), "s", [F.desc("k")]).count() == 0


def test_rules_files(spark):
    files = spark.createDataFrame([("h", "User-agent: *\nDisallow: /\n\nUser-agent: JobBot\nAllow: /\r\nDisallow: /x # no\n"), ("g", None), ("f", "Disallow: /\n")], "host string, body string")
    got = {(r["host"], r["prefix"], r["allow"]) for r in G.parsed_rules(files, "jobbot").collect()}
    assert got == {("h", "/", True), ("h", "/x", False)}


def test_partial_run_keeps_what_scored_and_prunes_nothing(spark):
    """A refused call in the middle of a board: scored postings are stored, held ones stay, the source counts a failure."""
    from jobloom.operators import ingest as I
    from jobloom.plans.stored import ingest_inputs, runs_of

    held, fetched, prefs, outcomes = ingest_inputs(spark, "/root/testdata/sf0.001")
    # every posting is new; two of the largest source that has preferences are refused
    held.jobs = held.jobs.withColumn("hash", F.lit("other"))
    wanted = fetched.join(prefs, "user_id", "left_semi").filter("doc_id % 6 <> 1")
    source = wanted.groupBy("source_id").count().orderBy(F.desc("count"), "source_id").first()["source_id"]
    two = [r["external_id"] for r in wanted.filter(F.col("source_id") == source).orderBy("doc_id").limit(2).collect()]
    fetched = fetched.filter(F.col("source_id") == source)
    refused = outcomes.withColumn("status", F.when(F.col("identity").isin(*two), 402).otherwise(200)).withColumn("body", F.when(F.col("status") == 402, '{"error": {"message": "no credit"}}').otherwise('{"score": 90}'))
    after, statuses = I.ingest_batch(held, fetched, runs_of(held.sources.filter(F.col("source_id") == source)), prefs, I.landed_scorer(refused), F.lit(2))
    names = {r["status"] for r in statuses.select("status").distinct().collect()}
    assert "unscored" in names and "kept" in names
    before = {r["identity"] for r in held.jobs.filter(F.col("source_id") == source).collect()}
    now = {r["identity"] for r in after.jobs.filter(F.col("source_id") == source).collect()}
    assert before <= now
    row = after.sources.filter(F.col("source_id") == source).collect()[0]
    assert row["consecutive_failures"] == 2 and ("no credit" in row["last_error"] or "timeout" in row["last_error"])
    # an inactive source is skipped
    paused = I.Snapshot(held.jobs, held.postings, held.sources.withColumn("status", F.lit("paused")))
    again, none = I.ingest_batch(paused, fetched, runs_of(held.sources), prefs, I.landed_scorer(refused), F.lit(2))
    assert none.count() == 0 and again.jobs.count() == held.jobs.count()


def test_helpers_by_name_in_sql(spark):
    X.register_functions(spark)
    assert spark.sql("SELECT fold_unicode('Ａß'), unescape_html('&eacute;'), blocked_v6('64:ff9b:1::808:808'), join_url('http://h/a/', 'b')").first()[:] == ("ass", "é", False, "http://h/a/b")


def test_usage_rows_are_appended(spark, tmp_path):
    calls = spark.createDataFrame([("u", "m", 1_000_000, 2_000_000, 7)], "user_id string, model string, input_tokens long, output_tokens long, source int")
    calls = calls.withColumn("input_rate", F.lit("3").cast("decimal(10,4)")).withColumn("output_rate", F.lit("15").cast("decimal(10,4)"))
    for _ in range(2):
        D.append_usage(D.usage_rows(calls, "job_match", "job_source", "source"), f"file://{tmp_path}/usage")
    total = C.usage_totals(spark.read.parquet(f"file://{tmp_path}/usage"), ["purpose", "related_kind", "related_id"]).first()
    assert (total["purpose"], total["related_id"], total["calls"], float(total["cost_usd"])) == ("job_match", "7", 2, 66.0)


def test_posting_keys(spark):
    rows = [("v", "7", "v:7"), ("v", "", None), ("v", None, None)]
    got = column(spark, rows, "v string, e string, k string", X.posting_key(F.col("v"), F.col("e"), F.lit("Foo Inc"), F.lit("T"), F.lit(None).cast("string")))
    assert got[0] == "v:7" and got[1] == got[2] and len(got[1]) == 64


def test_bodies_in_odd_charsets(spark):
    rows = [(b"\xff\xe9", "text/html; charset=latin-1"), (b"ok\xff", "text/html"), (b"x", "text/html; charset=nonsense"), (None, None)]
    assert column(spark, rows, "b binary, t string", L.decoded(F.col("b"), F.col("t"))) == ["ÿé", "ok�", None, None]


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    from jobloom.streaming import streams as R

    landed = f"file://{tmp_path}/in"
    read = lambda: spark.readStream.schema("a int").parquet(landed)
    spark.createDataFrame([(1,)], "a int").write.parquet(landed)
    assert R.drained(read(), base=f"file://{tmp_path}/run").count() == 1
    spark.createDataFrame([(2,)], "a int").write.mode("append").parquet(landed)
    assert sorted(r["a"] for r in R.drained(read(), base=f"file://{tmp_path}/run").collect()) == [1, 2]
