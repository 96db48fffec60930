"""State processors: jumps and closed forms against plain loops, late rows, and what the state holds after eviction."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobloom.streaming import processors as P
from jobloom.streaming import streams as R

TIMES = st.lists(st.integers(0, 60), max_size=30).map(sorted)
EVENT = st.tuples(st.integers(0, 60), st.sampled_from(["issue", "try"]), st.sampled_from(["a", "b", None]), st.sampled_from(["x", "y", None]))


@settings(max_examples=200, deadline=None)
@given(TIMES, st.one_of(st.none(), st.integers(-20, 0)), st.integers(-1, 25))
def test_marks_equal_a_loop(times, last, gap):
    want, at = [], last
    for t in times:
        hit = gap <= 0 or at is None or t - at >= gap
        at = t if hit else at
        want.append(hit)
    assert P.marks(np.array(times, "int64"), last, gap).tolist() == want


@settings(max_examples=200, deadline=None)
@given(TIMES.filter(len), st.integers(1, 20), st.integers(1, 20), st.integers(0, 30))
def test_sessions_split_in_two_equal_a_loop(times, refresh, ttl, cut):
    want, touched = [], None
    for t in times:
        live = touched is not None and t < touched + ttl
        if not live or t - touched >= refresh:
            touched = t
        want.append(live)
    got, state, rule = [], None, P.Sessions(refresh, ttl)
    for part in (times[:cut], times[cut:]):
        if part:
            columns, shown, state = rule.judge(np.array(part, "int64"), {}, state)
            got += columns["alive"].tolist()
            assert shown.all()
    assert got == want and state == (touched,)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([True, False, None]), min_size=1, max_size=30), st.integers(0, 30))
def test_streaks_split_in_two_equal_a_loop(failed, cut):
    want, run = [], 0
    for bad in failed:
        run = run + 1 if bad else 0
        want.append(run)
    got, state, rule = [], None, P.Streaks(3)
    for part in (failed[:cut], failed[cut:]):
        if part:
            columns, _, state = rule.judge(np.arange(len(part)), {"failed": np.array(part, object)}, state)
            got += columns["streak"].tolist()
            assert columns["stopped"].tolist() == [s >= 3 for s in columns["streak"]]
    assert got == want


@settings(max_examples=400, deadline=None)
@given(st.lists(EVENT, min_size=1, max_size=30).map(lambda e: sorted(e, key=lambda x: x[0])), st.integers(1, 3), st.integers(1, 30), st.integers(0, 30))
def test_attempts_split_in_two_equal_a_loop(events, most, ttl, cut):
    want, code, challenge, end, wrong = [], None, None, 0, 0
    for at, kind, tried, asked in events:
        if kind == "issue":
            code, challenge, end, wrong = tried, asked, at + ttl, 0
            continue
        result = "invalid"
        if code is not None and at < end and asked == challenge:
            wrong += tried != code
            result = "ok" if tried == code else "too_many_attempts" if wrong >= most else "invalid"
            code = None if result != "invalid" else code
        want.append(result)
    got, state, rule = [], None, P.Attempts(most, ttl)
    for part in (events[:cut], events[cut:]):
        if part:
            at, kind, tried, asked = (np.array(c, object) for c in zip(*part, strict=True))
            columns, shown, state = rule.judge(at.astype("int64"), {"kind": kind, "code": tried, "challenge": asked}, state)
            got += columns["result"][shown].tolist()
    assert got == want
    assert state[0] == code


@pytest.mark.parametrize("empty", [False, True])
def test_late_rows_and_eviction(spark, tmp_path, empty):
    """Late by the watermark or behind their key's row: given back, without effect; states that are over leave."""
    folder, hour = str(tmp_path / "in"), 3600
    batches = [
        [(1, "a", 0), (2, "b", 10), (3, "a", 5), (4, None, 7), (5, "c", None)],
        [(6, "a", 3), (7, "c", 50 * hour), (7, "c", 50 * hour)],  # 6: behind its key's row; 7 comes twice
        [(8, "d", 1), (9, "b", 49 * hour + 1), (10, "c", 50 * hour + 5)],  # 8: new key, behind the watermark
        [(11, "e", 60 * hour)],
    ]
    for rows in [[]] if empty else batches:
        df = spark.createDataFrame(rows, "event_id long, user_id string, s long").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).withColumn("late", F.lit("clash"))
        df.coalesce(1).write.mode("append").parquet(folder)
    base = str(tmp_path / "run")
    stream = R.session_stream(R.read_events(spark, folder, 1), "user_id", hour, 5 * hour)
    got = R.drained(stream, base=base)
    rows = [(r["event_id"], r["alive"], r["late"]) for r in got.collect()]
    if empty:
        assert rows == []
        return
    assert sorted(rows, key=str) == sorted([(1, False, False), (2, False, False), (3, True, False), (6, None, True), (7, False, False), (7, True, False), (8, None, True), (9, False, False), (10, True, False), (11, False, False)], key=str)
    # the watermark ends at 59 hours: only e's session can still matter
    state = spark.read.format("statestore").option("stateVarName", "state").load(f"file://{base}/state")
    assert [r[0] for r in state.select("key.user_id").collect()] == ["e"]


def test_keys_of_a_bucket_share_calls_and_states(spark, tmp_path):
    """As with a state a key: same rows, late ones too; a state a bucket, which holds only keys that can still matter."""
    folder, hour = str(tmp_path / "in"), 3600
    rows = [(n, (n * 7) % 40, "issue" if n % 5 == 0 else "try", "a" if n % 3 else None, "x", n * 600 + (-200 * hour if n % 41 == 0 else 0)) for n in range(600)]
    for k in range(3):
        df = spark.createDataFrame(rows[200 * k : 200 * k + 200], "event_id long, user_id long, kind string, code string, challenge string, s long")
        df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).coalesce(1).write.mode("append").parquet(folder)
    read = lambda: R.read_events(spark, folder, 1).withColumn("failed", F.col("kind") == "try")
    forms = {
        "dedupe": lambda b: R.dedupe_stream(read(), ["user_id", "kind"], 10 * hour, buckets=b), "failure": lambda b: R.failure_stream(read(), "user_id", "failed", buckets=b),
        "session": lambda b: R.session_stream(read(), "user_id", hour, 5 * hour, buckets=b), "attempts": lambda b: R.attempts_stream(read(), "user_id", 3, 9 * hour, buckets=b),
    }
    for name, form in forms.items():
        one, many = (sorted(map(str, R.drained(form(b), base=str(tmp_path / f"{name}-{b}")).collect())) for b in (None, 2))
        assert one == many and any("late=True" in r for r in one)
        state = lambda b: spark.read.format("statestore").option("stateVarName", "state").load(f"file://{tmp_path}/{name}-{b}/state")  # noqa: B023, E731
        held = state(2).select(F.explode("value.held_key"))
        assert state(2).count() <= 2 and held.count() == state(None).count()
