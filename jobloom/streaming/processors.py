"""Keyed rules as state processors: a key's rows are judged in time order as they come, its state leaves by timer, late rows are told apart.

A row is late if its time is behind the watermark, when its key's state may be gone, or if a later row of its key was
judged before it. Late rows change no state; they are given back with `late` and without a judgement. Rows of one time are
ordered by their number. A key's rows of a micro-batch are read batch by batch, of which the few columns that the rule
reads are kept as arrays until they are sorted; files a trigger bound them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Timed processors keep their state in this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def marks(times: np.ndarray, last: int | None, gap: int) -> np.ndarray:
    """Of ascending times, those at least gap after the last marked one; the first is marked if none was before. A jump a mark, not a step a row."""
    out = np.zeros(len(times), bool)
    if gap <= 0:
        return ~out
    at = 0 if last is None else int(np.searchsorted(times, last + gap))
    while at < len(times):
        out[at] = True
        at = int(np.searchsorted(times, times[at] + gap))
    return out


class Ordered(StatefulProcessor):
    """Takes a key's rows in order. A rule gives `judge`, its `fields` (columns that it reads) and `kept` (the schema of its state).

    The state is (at_us, at_id) of the last judged row and the rule's own fields. It leaves when the watermark has passed what `until` gives.
    """

    fields: tuple[str, ...] = ()
    kept = ""
    given: dict[str, str] = {}  # columns of the output and their types

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "at_us long, at_id long" + (f", {self.kept}" if self.kept else ""))

    def judge(self, us: np.ndarray, rows: dict[str, np.ndarray], state: tuple | None) -> tuple[dict[str, np.ndarray], np.ndarray, tuple]:
        """Columns of the judged rows, which of them are given back, and the rule's new state."""
        raise NotImplementedError

    def until(self, us: int, state: tuple) -> int | None:
        """Microseconds from which on the state says no more than its absence; None: it stays."""
        raise NotImplementedError

    def take(self, us: np.ndarray, ids: np.ndarray, rest: list[np.ndarray], old: tuple | None, watermark: int) -> tuple[np.ndarray, dict[str, np.ndarray], tuple | None, np.ndarray]:
        """One key's rows in order, after its state: numbers and columns of those given back, the new state (None: no row was judged), numbers of late rows."""
        late = us // 1000 < watermark
        if old is not None:
            late |= (us < old[0]) | (us == old[0]) & (ids < old[1])
        now = ~late
        if not now.any():
            return ids[:0], {}, None, ids
        columns, shown, new = self.judge(us[now], {n: r[now] for n, r in zip(self.fields, rest, strict=True)}, None if old is None else tuple(old[2:]))
        return ids[now][shown], {n: c[shown] for n, c in columns.items()}, (int(us[now][-1]), int(ids[now][-1]), *new), ids[late]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [[pdf[c].to_numpy() for c in ("at_us", "at_id", *self.fields)] for pdf in rows]
        us, ids, *rest = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((ids, us))
        old = self.state.get() if self.state.exists() else None
        shown, columns, new, late = self.take(us[order], ids[order], [r[order] for r in rest], old, timerValues.getCurrentWatermarkInMs())
        if new is not None:
            self.state.update(new)
            end = self.gone(new)
            if end is not None:
                self.handle.registerTimer(max(end, timerValues.getCurrentWatermarkInMs() + 1))
            yield self._out(shown, columns, False)
        if len(late):
            yield self._out(late, {}, True)

    def gone(self, held: tuple) -> int | None:
        """The watermark (milliseconds) from which on a key's state may leave; behind its last row, so that what comes to no state is never before it."""
        end = self.until(held[0], tuple(held[2:]))
        return None if end is None else max(math.ceil(end / 1000), held[0] // 1000 + 1)

    def _out(self, ids: np.ndarray, columns: dict[str, np.ndarray], late: bool) -> pd.DataFrame:
        out = {"event_id": ids.astype("int64")}
        for name in self.given:
            out[name] = columns.get(name, np.full(len(ids), None, object))
        return pd.DataFrame(out | {"late": late})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            end = self.gone(self.state.get())
            # an older timer of a state that lives on
            if end is not None and end <= timerValues.getCurrentWatermarkInMs():
                self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Processed(Ordered):
    """A key's first row, and each at least ttl after the last processed one; others aren't given back."""

    kept = "processed long"

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def judge(self, us, rows, state):
        keep = marks(us, None if state is None else state[0], self.ttl)
        last = int(us[keep][-1]) if keep.any() else state[0]
        return {}, keep, (last,)

    def until(self, us, state):
        return state[0] + self.ttl


class Streaks(Ordered):
    """Failures in a row with each run, and whether that stops the source. A source's count stays: any later run goes on from it."""

    fields = ("failed",)
    kept = "run long"
    given = {"streak": "long", "stopped": "boolean"}

    def __init__(self, max_failures: int):
        self.most = max_failures

    def judge(self, us, rows, state):
        bad = np.array([x is not None and x == x and bool(x) for x in rows["failed"]])
        place = np.arange(1, len(bad) + 1)
        good = np.maximum.accumulate(np.where(bad, 0, place))
        streak = np.where(good > 0, place - good, place + (state[0] if state else 0))
        return {"streak": streak, "stopped": streak >= self.most}, np.ones(len(bad), bool), (int(streak[-1]),)

    def until(self, us, state):
        return None


class Sessions(Ordered):
    """Whether an access finds its session alive; a touch moves its end if the last recorded one is at least refresh ago, or the session is over."""

    kept = "touched long"
    given = {"alive": "boolean"}

    def __init__(self, refresh_us: int, ttl_us: int):
        self.refresh, self.ttl = refresh_us, ttl_us

    def judge(self, us, rows, state):
        before = None if state is None else state[0]
        touch = marks(us, before, min(self.refresh, self.ttl))
        last = np.maximum.accumulate(np.where(touch, np.arange(len(us)), -1))
        prior = np.concatenate([[-1], last[:-1]])
        alive = np.where(prior >= 0, us < us[prior] + self.ttl, False if before is None else us < (before or 0) + self.ttl)
        return {"alive": alive}, np.ones(len(us), bool), (int(us[last[-1]]) if last[-1] >= 0 else before,)

    def until(self, us, state):
        return state[0] + self.ttl


class Attempts(Ordered):
    """Tries of a code that an issue sets: ok, invalid or too_many_attempts; an issue is not given back. Closed between two issues, so no step a row."""

    fields = ("kind", "code", "challenge")
    kept = "code string, challenge string, ends long, wrong long"
    given = {"result": "string"}

    def __init__(self, max_attempts: int, ttl_us: int):
        self.most, self.ttl = max_attempts, ttl_us

    def judge(self, us, rows, state):
        known = lambda c: np.array([None if x is None or x != x else x for x in rows[c]] + [None], object)[:-1]
        issue = known("kind") == "issue"
        given, asked = known("code"), known("challenge")
        code, challenge, ends, wrong = state or (None, None, 0, 0)
        at = np.cumsum(issue)
        started = lambda first, values: np.concatenate([np.array([first, None], object)[:1], values])
        codes, challenges = started(code, given[issue])[at], started(challenge, asked[issue])[at]
        end = np.concatenate([[ends], us[issue] + self.ttl])[at]
        counted = ~issue & (codes != None) & (us < end) & (asked == challenges)  # noqa: E711
        right = (counted & (given == codes)).astype("int64")
        miss = (counted & (given != codes)).astype("int64")

        def before(n: np.ndarray, first: int) -> np.ndarray:
            so_far = np.cumsum(n)
            return so_far - n - np.concatenate([[-first], so_far[issue]])[at]

        rights, misses = before(right, 0), before(miss, wrong)
        live = (rights == 0) & (misses < self.most)
        result = np.where(live & (right == 1), "ok", np.where(live & (miss == 1) & (misses == self.most - 1), "too_many_attempts", "invalid")).astype(object)
        tries = int(misses[-1] + miss[-1])
        if codes[-1] is None or rights[-1] + right[-1] > 0 or tries >= self.most:
            new = (None, None, 0, 0)
        else:
            new = (codes[-1], challenges[-1], int(end[-1]), tries)
        return {"result": result}, ~issue, new

    def until(self, us, state):
        return state[2] if state[0] is not None else us


class Shared(StatefulProcessor):
    """A rule for all keys of a bucket: one call, one state and one timer for many keys, each judged apart as by the rule itself.

    A call, a state's way to the store and back and a frame given back cost milliseconds, many times what a key's rows do. The state holds the
    bucket's live keys side by side and is written whole; the timer is the first one's at which a key may leave, when all that may leave do.
    """

    def __init__(self, rule: Ordered):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept = [f.split(" ") for f in self.rule.kept.split(", ") if f]
        lists = [("held_key", "string"), ("at_us", "long"), ("at_id", "long"), *kept]
        self.state = handle.getValueState("state", ", ".join(f"{n} array<{t}>" for n, t in lists) + ", alarm long")

    def _held(self) -> tuple[dict[str, tuple], int | None]:
        if not self.state.exists():
            return {}, None
        names, *lists, alarm = self.state.get()
        return dict(zip(names, zip(*lists, strict=True), strict=True)), alarm

    def _hold(self, held: dict[str, tuple], alarm: int | None, timerValues) -> None:
        if not held:
            self.state.clear()
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        ends = [e for e in map(self.rule.gone, held.values()) if e is not None]
        if ends and (alarm is None or min(ends) < alarm):
            alarm = max(min(ends), watermark + 1)
            self.handle.registerTimer(alarm)
        self.state.update((list(held), *map(list, zip(*held.values(), strict=True)), alarm))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [[pdf[c].to_numpy() for c in ("key_text", "at_us", "at_id", *self.rule.fields)] for pdf in rows]
        codes, us, ids, *rest = (np.concatenate(p) for p in zip(*parts, strict=True))
        codes, names = pd.factorize(codes)
        order = np.lexsort((ids, us, codes))
        us, ids, rest = us[order], ids[order], [r[order] for r in rest]
        ends = np.cumsum(np.bincount(codes, minlength=len(names))).tolist()
        held, alarm = self._held()
        watermark = timerValues.getCurrentWatermarkInMs()
        shown, columns, late, changed, start = [], [], [], False, 0
        for name, end in zip(names, ends, strict=True):
            own, given, new, behind = self.rule.take(us[start:end], ids[start:end], [r[start:end] for r in rest], held.get(name), watermark)
            start = end
            if new is not None:
                held[name], changed = new, True
                shown.append(own)
                columns.append(given)
            late.append(behind)
        if changed:
            self._hold(held, alarm, timerValues)
            yield self.rule._out(np.concatenate(shown), {n: np.concatenate([c[n] for c in columns]) for n in columns[0]}, False)
        late = np.concatenate(late)
        if len(late):
            yield self.rule._out(late, {}, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, alarm = self._held()
        if held:
            watermark = timerValues.getCurrentWatermarkInMs()
            ends = {name: self.rule.gone(state) for name, state in held.items()}
            live = {name: state for name, state in held.items() if ends[name] is None or ends[name] > watermark}
            self._hold(live, None if alarm is not None and alarm <= watermark else alarm, timerValues)
        return iter(())

    def close(self) -> None:
        pass


def judged(events: DataFrame, key: list[str], time: str, order: str, processor: Ordered, delay: str, buckets: int | None = None) -> DataFrame:
    """`event_id`, the processor's columns and `late`, of a stream with a key and a time; rows without either belong to nobody.

    Without buckets each key has a state and a call of its own, which many keys with few rows make slow; with them, keys that fall into one bucket share those.
    A task holds one bucket's rows of a micro-batch at a time. A stream's buckets must not change between its runs.
    The watermark runs on a copy of the time that only copies of the rows carry, which leave behind it: so it advances,
    but drops no late row before the processor sees it. Times are after 1970.
    """
    schema = ", ".join(["event_id long", *(f"{n} {t}" for n, t in processor.given.items()), "late boolean"])
    known = events.filter(" AND ".join(f"{c} IS NOT NULL" for c in (*key, time, order)))
    rows = known.select(*key, F.unix_micros(time).alias("at_us"), F.col(order).cast("long").alias("at_id"), *processor.fields, F.col(time).alias("_at"))
    if buckets:
        # a key as text: the same for equal keys alone
        named = F.to_json(F.struct(*key)).alias("key_text")
        rows = rows.select(F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("_bucket"), named, *(c for c in rows.columns if c not in key))
        key, processor = ["_bucket"], Shared(processor)
    ticks = rows.withColumn("_clock", F.explode(F.array(F.col("_at"), F.lit(None).cast("timestamp")))).drop("_at")
    ticked = ticks.withWatermark("_clock", delay).filter("_clock IS NULL")
    return ticked.groupBy(*key).transformWithStateInPandas(processor, schema, "append", "EventTime")
