"""Bucketed stored tables, unique jobs, usage rows and outcome parsing of the ingest."""

import os

import pytest
from pyspark.sql import functions as F

from jobloom.functions import numbers as N
from jobloom.functions import text as X
from jobloom.operators import ingest as I
from jobloom.plans.stored import ingest_inputs, runs_of

SF = "/root/testdata/sf0.001"
JOBS = "source_id string, user_id int, identity string, external_id string, url string, dedup_key string, hash string, structured string, match_score int, first_seen int, last_seen int"
POSTINGS = "user_id int, dedup_key string, company_name string, company_name_normalized string, canonical_title string, location_normalized string, structured string, match_score int"


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def stored(spark, sources=300, each=40):
    ids = spark.range(sources * each).select((F.col("id") % sources).alias("s"), F.col("id").alias("i"))
    jobs = ids.select(
        F.concat(F.lit("s"), "s").alias("source_id"), F.col("s").cast("int").alias("user_id"), F.concat(F.lit("e"), "i").alias("identity"), F.concat(F.lit("e"), "i").alias("external_id"), F.concat(F.lit("u"), "i").alias("url"),
        F.concat(F.lit("k"), "i").alias("dedup_key"), F.sha2(F.col("i").cast("string"), 256).alias("hash"), F.lit("{}").alias("structured"), F.lit(1).alias("match_score"), F.lit(1).alias("first_seen"), F.lit(1).alias("last_seen"),
    )
    postings = jobs.select("user_id", "dedup_key", F.lit("c").alias("company_name"), F.lit("c").alias("company_name_normalized"), F.lit("t").alias("canonical_title"), F.lit(None).cast("string").alias("location_normalized"), "structured", "match_score")
    return I.Snapshot(jobs, postings, jobs.select("source_id", "user_id").distinct().withColumn("note", F.lit("a")))


def test_a_batch_rewrites_its_own_buckets(spark, tmp_path):
    store = I.SnapshotStore(spark, f"file://{tmp_path}/store", buckets=100, parts=4)
    held = stored(spark)
    store.write(-1, held)
    whole = size_of(f"{tmp_path}/store/jobs")
    touched = spark.createDataFrame([("s7",), ("s150",), ("s299",)], "source_id string")
    for number in (0, 1, 1):  # the second number runs twice, as after a failure
        part = store.before(number, touched)
        assert part.jobs.count() < 800 and part.jobs.filter("source_id IN ('s7', 's150', 's299')").count() == (120 if number == 0 else 119)
        changed = part.jobs.withColumn("last_seen", F.when(F.col("source_id").isin("s7", "s150", "s299"), F.col("last_seen") + 1).otherwise(F.col("last_seen")))
        store.write(number, I.Snapshot(changed.filter("identity <> 'e7'"), part.postings, part.sources), touched)
        assert size_of(f"{tmp_path}/store/jobs/batch={number}") < 0.05 * whole
    assert store.batches() == [-1, 0, 1]
    after = store.read(1)
    assert after.jobs.count() == 300 * 40 - 1 and after.postings.count() == 300 * 40 and after.sources.count() == 300
    seen = {r["last_seen"]: r["count"] for r in after.jobs.groupBy("last_seen").count().collect()}
    assert seen == {1: 300 * 40 - 120, 3: 119}
    assert store.read(-1).jobs.count() == 300 * 40
    before = size_of(f"{tmp_path}/store")
    assert store.expire(keep=1) > 0 and size_of(f"{tmp_path}/store") < before and store.batches() == [1]
    assert store.read(1).jobs.count() == 300 * 40 - 1 and store.expire(keep=1) == 0


def test_a_bucket_that_empties_and_an_unfinished_batch(spark, tmp_path):
    store = I.SnapshotStore(spark, f"file://{tmp_path}/store", buckets=100, parts=4)
    store.write(-1, stored(spark, 5, 2))
    touched = spark.createDataFrame([("s1",)], "source_id string")
    part = store.before(0, touched)
    store.write(0, I.Snapshot(part.jobs.filter("source_id <> 's1'"), part.postings, part.sources), touched)
    assert store.read(0).jobs.count() == 8
    spark.range(3).write.parquet(f"file://{tmp_path}/store/jobs/batch=1/bucket=3")  # files without a manifest don't count
    assert store.batches() == [-1, 0] and store.before(2).jobs.count() == 8
    with pytest.raises(ValueError):
        store.before(-1)


def fetched_rows(spark, rows):
    """(source, user, external id, url, vendor, company, place)"""
    base = spark.createDataFrame(rows, "source_id string, user_id int, external_id string, url string, ats_vendor string, company_name string, place int")
    null = lambda kind: F.lit(None).cast(kind)
    none = F.array().cast("array<string>")
    return base.select(
        "*", F.lit("ats").alias("source_type"), F.lit("Engineer").alias("title"), null("string").alias("location"), null("boolean").alias("remote"), null("string").alias("employment_type"), null("long").alias("salary_min"), null("long").alias("salary_max"),
        none.alias("required_skills"), none.alias("preferred_skills"), F.concat(F.lit("text "), "place").alias("description"), null("string").alias("apply_url"), F.when(F.col("place") == 1, F.array(F.lit("salary"))).otherwise(none).alias("needs_review"),
    )


@pytest.fixture
def board(spark):
    fetched = fetched_rows(spark, [
        ("s", 1, "1", "http://u/1", "v", "A", 0), ("s", 1, "2", "http://u/1", "v", "B", 1), ("s", 1, None, "http://u/3", None, "Foo Inc", 2), ("t", 1, "http://u/9", "http://u/9", None, "Foo", 3), ("s", 1, "5", "http://u/old", "v", "C", 4),
    ])
    jobs = spark.createDataFrame([("s", 1, "9", "9", "http://u/old", "v:9", "h", "{}", 5, 1, 1), ("s", 1, "5", "5", "http://u/five", "v:5", "h", "{}", 5, 1, 1)], JOBS)
    sources = ingest_inputs(spark, SF)[0].sources
    sources = spark.createDataFrame([("s",), ("t",)], "source_id string").select("source_id", F.lit(1).alias("user_id"), *(F.lit("active").alias(c) if c == "status" else F.lit(0).cast("long").alias(c) if c == "consecutive_failures" else F.lit(None).cast(k).alias(c) for c, k in sources.dtypes[2:]))
    prefs = spark.createDataFrame([(1, [], False, [], [])], "user_id int, employment_types array<string>, remote_required boolean, locations array<string>, desired_roles array<string>")
    told = fetched.select("source_id", X.identity(F.col("external_id"), F.col("url")).alias("identity"), F.lit(200).alias("status"), F.lit('{"score": 80, "rationale": "fits"}').alias("body"), F.lit("m").alias("model"), F.lit(1_000_000).alias("input_tokens"), F.lit(0).alias("output_tokens"), F.lit("3").alias("input_rate"), F.lit("15").alias("output_rate"))
    runs = runs_of(sources).withColumn("error", F.lit(None).cast("string"))
    return I.ingest_batch(I.Snapshot(jobs, spark.createDataFrame([], POSTINGS), sources), fetched, runs, prefs, I.landed_scorer(told), F.lit(2), position="place")


def test_jobs_stay_unique(board):
    after, statuses = board
    got = {(r["source_id"], r["url"]): r for r in after.jobs.collect()}
    assert len(got) == after.jobs.count() == 4 and {r["status"] for r in statuses.collect()} == {"kept"}
    one = got["s", "http://u/1"]  # the later of two postings with one address
    assert (one["external_id"], one["needs_review"], one["source_type"], one["ats_vendor"], one["first_seen"]) == ("2", True, "ats", "v", 2)
    assert '"description":"text 1"' in one["raw_text"] and '"rationale":"fits"' in one["structured"]
    moved = got["s", "http://u/old"]  # job 5 takes the address of job 9, which goes
    assert (moved["external_id"], moved["first_seen"], moved["last_seen"]) == ("5", 1, 2)


def test_boards_without_a_vendor_meet(board):
    after, _ = board
    keys = {(r["source_id"], r["url"]): r["dedup_key"] for r in after.jobs.collect()}
    assert keys["s", "http://u/3"] == keys["t", "http://u/9"] and len(keys["t", "http://u/9"]) == 64
    assert after.postings.filter(F.col("dedup_key") == keys["t", "http://u/9"]).count() == 1


def test_usage_of_scored_and_kept_postings(board):
    usage = I.batch_usage(board[1]).collect()
    assert len(usage) == 5 and {(r["purpose"], r["related_kind"], float(r["cost_usd"])) for r in usage} == {("job_match", "job_source", 3.0)} and {r["related_id"] for r in usage} == {"s", "t"}


def test_a_scorer_without_tokens_has_no_usage(spark):
    held, fetched, prefs, outcomes = ingest_inputs(spark, SF)
    after, statuses = I.ingest_batch(held, fetched, runs_of(held.sources), prefs, I.landed_scorer(outcomes), F.lit(2))
    assert I.batch_usage(statuses).count() == 0 and {"raw_text", "needs_review", "source_type", "ats_vendor"} <= set(after.jobs.columns)


def test_posting_key_needs_vendor_and_id(spark):
    rows = spark.createDataFrame([("v", "7"), (None, "https://a/1"), ("", "7"), ("v", ""), (None, None)], "v string, e string")
    got = [r[0] for r in rows.select(X.posting_key(F.col("v"), F.col("e"), F.lit("Foo"), F.lit("T"), F.lit(None).cast("string"))).collect()]
    assert got[0] == "v:7" and len(set(got[1:])) == 1 and len(got[1]) == 64


def test_outcomes(spark):
    bodies = ['{"score": 7.5}', '{"score": 7.0, "rationale": "x"}', '{"score": 8, "rationale": 3}', '{"score": 9, "rationale": null}', '{"score": true}', '{"score": "about 60%"}', '{"score": 101}', "no json", None, '{"score": "x", "matched": "a", "concerns": ["b", "c"]}']
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select(N.parse_outcome(F.col("b")).alias("o")).select("o.*").collect()
    assert [r["score"] for r in rows] == [None, 7, None, None, 1, 60, None, None, None, 0]
    assert rows[1]["rationale"] == "x" and rows[0]["rationale"] == "" and rows[9]["matched"] == ["a"] and rows[9]["concerns"] == ["b", "c"]


def test_a_batch_carries_the_jobs_of_its_own_sources(spark, tmp_path):
    """Of the users' other jobs a batch reads the keys alone, and they still hold their postings."""
    held, fetched, prefs, outcomes = ingest_inputs(spark, SF)
    few = [r[0] for r in held.sources.orderBy("source_id").limit(3).collect()]
    runs = runs_of(held.sources.filter(F.col("source_id").isin(few)))
    # postings whose jobs are in other parts, without a job of the touched sources
    shared = held.jobs.filter(~F.col("source_id").isin(few)).select("user_id", "dedup_key")
    store = I.SnapshotStore(spark, f"file://{tmp_path}/store")
    store.write(-1, held)
    mine = store.before(0, runs)
    parts = {r[0] for r in held.sources.filter(F.col("source_id").isin(few)).select(store._bucket("jobs")).collect()}
    assert {r[0] for r in mine.jobs.select(store._bucket("jobs")).distinct().collect()} <= parts
    assert mine.elsewhere.columns == ["user_id", "dedup_key"] and mine.elsewhere.count() > 0
    batch = fetched.filter(F.col("source_id").isin(few))
    whole, _ = I.ingest_batch(held, batch, runs, prefs, I.landed_scorer(outcomes), F.lit(2))
    some, _ = I.ingest_batch(mine, batch, runs, prefs, I.landed_scorer(outcomes), F.lit(2))
    store.write(0, some, runs)
    after = store.read(0)
    for table, key in (("jobs", ["source_id", "identity", "last_seen"]), ("postings", ["user_id", "dedup_key", "match_score"])):
        got, want = (sorted(map(tuple, getattr(s, table).select(*key).collect()), key=str) for s in (after, whole))
        assert got == want
    assert after.postings.join(shared, ["user_id", "dedup_key"], "left_semi").count() == shared.distinct().count()
