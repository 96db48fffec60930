"""Rules over running sums and maxima with nine tenths of the rows on one key, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from jobloom.operators import clustering as C
from jobloom.operators import pacing as P
from jobloom.operators import scan as N
from jobloom.operators import state as S


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.9 else rng.choice(["a", "b", "c", None])
        rows.append((i, key, float(rng.randrange(0, 4000)) / 2, rng.random() < 0.3, rng.choice([None, *range(50)]), rng.choice([0.5, 1.0, 2.0])))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    yield rows, spark.createDataFrame(rows, "event_id int, key string, t double, ok boolean, score int, gap double")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_a_hot_key_spreads(log):
    placed = N.in_ranges(log[1], ["key"], ["t", "event_id"])
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    hot = placed.filter("key = 'hot'").select("_range").distinct().count()
    assert hot >= 9


def test_running_sums_and_maxima(log):
    placed = N.in_ranges(log[1], ["key"], ["t", "event_id"])
    for before in (False, True):
        got = {r["event_id"]: (r["s"], r["m"]) for r in N.running(placed, ["key"], ["t", "event_id"], {"s": F.col("score")}, {"m": F.col("score")}, before).collect()}
        for rows in by_key(log[0]).values():
            total, most = 0, None
            for r in rows:
                now = (total + (r[4] or 0), r[4] if most is None else most if r[4] is None else max(most, r[4]))
                assert got[r[0]] == ((total, most) if before else now)
                total, most = now


def test_streaks_windows_and_pacing(log):
    streak = {r["event_id"]: r["streak"] for r in P.failure_streak(log[1], "key", ["t", "event_id"], F.col("ok")).collect()}
    allowed = {r["event_id"]: r["allowed"] for r in P.fixed_window_limit(log[1], ["key"], F.col("t"), ["t", "event_id"], 20, 60).collect()}
    start = {r["event_id"]: r["start"] for r in P.pace(log[1], "key", "t", ["t", "event_id"], F.col("gap")).collect()}
    for rows in by_key(log[0]).values():
        run, hits, last = 0, {}, None
        for r in rows:
            run = 0 if r[3] else run + 1
            hits[r[2] // 60] = hits.get(r[2] // 60, 0) + 1
            last = r[2] if last is None else max(r[2], last + r[5])
            assert streak[r[0]] == run and allowed[r[0]] == (hits[r[2] // 60] <= 20) and abs(start[r[0]] - last) < 1e-6


def test_best_view_of_a_hot_key(log):
    got = {r["key"]: (r["view"]["event_id"], r["best_score"]) for r in C.best_view(log[1], ["key"], ["t", "event_id"], "score").collect()}
    for key, rows in by_key(log[0]).items():
        view, best = None, None
        for r in rows:
            if r[4] is None or best is None or r[4] >= best:
                view = r[0]
            best = r[4] if best is None else best if r[4] is None else max(best, r[4])
        assert got[key] == (view, best)


@pytest.mark.parametrize("ttl", [0.0, 0.5, 7.0, 40.0, 1e6])
def test_dedupe_of_a_hot_key(log, ttl):
    got = {r["event_id"] for r in S.dedupe_ttl(log[1], ["key"], "t", "event_id", ttl).collect()}
    want = set()
    for key, rows in by_key(log[0]).items():
        last = None
        for r in rows:
            if key is not None and (last is None or r[2] - last >= ttl):
                last = r[2]
                want.add(r[0])
    assert got == want


@pytest.mark.parametrize(("refresh", "ttl"), [(3.0, 20.0), (20.0, 3.0), (0.0, 5.0), (50.0, 60.0)])
def test_sessions_of_a_hot_key(log, refresh, ttl):
    got = {r["event_id"]: (r["alive"], r["expires"]) for r in S.sliding_sessions(log[1], "key", "t", "event_id", refresh, ttl).collect()}
    count = 0
    for key, rows in by_key(log[0]).items():
        touched = None
        for r in rows if key is not None else []:
            alive = touched is not None and r[2] < touched + ttl
            if not alive or r[2] - touched >= refresh:
                touched = r[2]
            assert got[r[0]] == (alive, touched + ttl)
            count += 1
    assert count == len(got)


def test_long_walk_without_a_pause(spark):
    """A walk of thousands of steps is found in the logarithm of that many rounds."""
    log = spark.range(20_000).select(F.lit("k").alias("key"), F.col("id").alias("event_id"), (F.col("id") / 4).alias("t"))
    assert sorted(r[0] for r in S.dedupe_ttl(log, ["key"], "t", "event_id", 1.0).select("event_id").collect()) == list(range(0, 20_000, 4))
    assert S.dedupe_ttl(log.limit(0), ["key"], "t", "event_id", 1.0).count() == 0
