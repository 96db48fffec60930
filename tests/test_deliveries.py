"""Retry and dead-letter outputs under failures, and keyed streams over several batches."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobloom.operators import pacing as P
from jobloom.operators import state as S
from jobloom.streaming import deliveries as Q
from jobloom.streaming import streams as R

SF = "/root/testdata/sf0.001"
MESSAGE = "id long, task string, fails int, ok_until string"


def handle(rows):
    """fails: how often a message fails; null: always."""
    return rows.withColumn("ok", F.col("receives") > F.col("fails"))


def land(spark, folder, rows):
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("when", ["before", "after"])
def test_killed_batch_leaves_no_doubles(spark, tmp_path, when):
    folder = str(tmp_path / "landed")
    rows = [(i, None if i % 11 == 0 else "odd" if i % 13 == 0 else "fetch", None if i % 17 == 0 else i % 5, "x" if i % 2 else None) for i in range(120)]
    rows[5] = rows[4]  # two deliveries of one message stay two
    for n in range(6):
        land(spark, folder, rows[n * 20 : n * 20 + 20])
    log = Q.DeliveryLog(spark, str(tmp_path / "log"), spark.read.parquet(folder).schema)
    whole = log.step
    broken = []

    def failing(at, *rest):
        if at[0] == 3 and not broken:
            broken.append(at)
            if when == "after":
                whole(at, *rest)
            raise RuntimeError("killed")
        whole(at, *rest)

    log.step = failing
    with pytest.raises(Exception, match="killed"):
        Q.deliver_stream(stream(spark, folder), log, handle, ("fetch",), 3)
    assert broken == [(3, 0)]
    Q.deliver_stream(stream(spark, folder), log, handle, ("fetch",), 3)
    assert log.steps() == [(n, 0) for n in range(6)]
    assert log.read("retry").count() > 0
    rounds = 0
    while Q.redrive(log, handle, ("fetch",), 3):
        rounds += 1
    assert rounds == 2
    want = Counter()
    for i, task, fails, _ in rows:
        good = task == "fetch" and fails is not None and fails < 3
        want[i, "done" if good else "dead", fails + 1 if good else 3] += 1
    assert Counter((r["id"], r["route"], r["receives"]) for r in log.read("done", "dead", "retry").collect()) == want
    # a later run takes new messages; nothing old comes again
    land(spark, folder, [(500, "fetch", 0, None), (501, "fetch", 9, None)])
    Q.deliver_stream(stream(spark, folder), log, handle, ("fetch",), 3)
    assert [(r["id"], r["receives"]) for r in log.read("retry").collect()] == [(501, 1)]
    assert log.read("done").count() == sum(n for k, n in want.items() if k[1] == "done") + 1


def test_empty_log(spark, tmp_path):
    log = Q.DeliveryLog(spark, str(tmp_path / "log"), spark.createDataFrame([], MESSAGE).schema)
    assert log.read("done", "dead", "retry").count() == 0 and not Q.redrive(log, handle, ("fetch",))


def test_streams_of_six_batches_equal_batch_forms(spark, tmp_path):
    """Files in time order, one a batch: keyed state goes from one batch to the next."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    cuts = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).approxQuantile("t", [k / 6 for k in range(1, 6)], 0.0)
    place = sum(((F.unix_micros(F.col("ts").cast("timestamp")) > c).cast("int") for c in cuts), F.lit(0))
    folder = str(tmp_path / "events")
    for k in range(6):
        events.filter(place == k).coalesce(1).write.mode("append").parquet(folder)
    read = lambda: R.read_events(spark, folder, 1).withColumn("failed", F.col("event_type") == "error")
    timed = events.withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    got = R.drained(R.dedupe_stream(read(), ["user_id", "event_type"], 86400))
    assert got.select("batch").distinct().count() == 6
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(got.select("event_id"), S.dedupe_ttl(timed, ["user_id", "event_type"], "s", "event_id", 86400).select("event_id"))
    assert same(R.drained(R.session_stream(read(), "user_id", 21600, 86400)).select("event_id", "alive"), S.sliding_sessions(timed, "user_id", "s", "event_id", 21600, 86400).select("event_id", "alive"))
    streaks = P.failure_streak(timed.filter("user_id IS NOT NULL"), "user_id", ["s", "event_id"], F.col("event_type") != "error")
    assert same(R.drained(R.failure_stream(read(), "user_id", "failed")).select("event_id", "streak"), streaks.select("event_id", "streak"))
