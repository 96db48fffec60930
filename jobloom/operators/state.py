"""Rules whose next step depends on the last accepted event: batch forms without a task or a row for a whole key.

Null keys belong to nobody and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import first_by_steps, in_ranges, running


def dedupe_ttl(events: DataFrame, key: list[str], seconds: str, order: str, ttl: float) -> DataFrame:
    """Rows that are processed: a key's first, and each at least ttl after the last processed one; duplicates don't prolong.

    Equal times are taken by order, which tells a key's events apart. Without a time to live every row is processed.
    """
    if ttl <= 0:
        return events.dropna(subset=key)
    return first_by_steps(events, key, seconds, order, ttl).filter("_step").select(*events.columns)


def sliding_sessions(events: DataFrame, key: str, seconds: str, order: str, refresh: float, ttl: float) -> DataFrame:
    """events with `alive` and `expires`: the first creates a session; one that finds it expired (at or after its end) creates anew and is not alive before.

    A touch is recorded, and moves the end, only if the last recorded one is at least `refresh` ago, or the session has expired.
    """
    gap = min(refresh, ttl)
    if gap > 0:
        stepped = first_by_steps(events, [key], seconds, order, gap).drop("_range")
    else:
        stepped = events.dropna(subset=[key]).withColumn("_t", F.col(seconds).cast("double")).withColumn("_step", F.lit(True))
    placed = in_ranges(stepped, [key], ["_t", order])
    touch = F.when(F.col("_step"), F.col("_t"))
    rows = running(placed, [key], ["_t", order], maxima={"_before": touch}, before=True)
    now = F.when(F.col("_step"), F.col("_t")).otherwise(F.col("_before"))
    alive = F.coalesce(F.col(seconds) < F.col("_before") + ttl, F.lit(False))
    return rows.select(*events.columns, alive.alias("alive"), (now + ttl).alias("expires"))


def replay_attempts(log: DataFrame, key: str, seconds: str, order: str, kind: str, code: str, challenge: str, max_attempts: int, ttl: float) -> DataFrame:
    """Verify events of a log of issues and verifications with `result`: ok, invalid or too_many_attempts.

    An issue replaces the live code and its count. Expired, absent or otherwise challenged codes are invalid uncounted;
    a wrong code counts, and the last allowed wrong one removes the code; success uses it up. Between two issues this is
    closed: a counted try finds a live code if no right one and fewer than max_attempts wrong ones came before it.
    """
    so_far = Window.partitionBy(key).orderBy(seconds, order).rowsBetween(Window.unboundedPreceding, 0)
    issued = F.col(kind) == "issue"
    rows = log.dropna(subset=[key]).withColumn("_issue", F.last(F.when(issued, F.struct(F.col(seconds).alias("s"), F.col(order).alias("o"), F.col(code).alias("code"), F.col(challenge).alias("challenge"))), ignorenulls=True).over(so_far))
    rows = rows.filter(~issued)
    counted = F.coalesce((F.col(seconds) < F.col("_issue.s") + ttl) & F.col(challenge).eqNullSafe(F.col("_issue.challenge")), F.lit(False))
    right = F.col(code).eqNullSafe(F.col("_issue.code"))
    rows = rows.withColumn("_right", (counted & right).cast("int")).withColumn("_wrong", (counted & ~right).cast("int"))
    w = Window.partitionBy(key, "_issue.s", "_issue.o").orderBy(seconds, order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    rows = rows.withColumn("_rights", before("_right")).withColumn("_wrongs", before("_wrong"))
    live = (F.col("_rights") == 0) & (F.col("_wrongs") < max_attempts)
    result = F.when(live & (F.col("_right") == 1), "ok").when(live & (F.col("_wrong") == 1) & (F.col("_wrongs") == max_attempts - 1), "too_many_attempts").otherwise("invalid")
    return rows.select(*log.columns, result.alias("result"))


def route_deliveries(attempts: DataFrame, receives: str, ok: Column, known_task: Column, max_receive: int = 3) -> DataFrame:
    """attempts with `route`: done, retry, or dead once received max_receive times; unknown tasks fail like others."""
    good = F.coalesce(ok & known_task, F.lit(False))
    return attempts.withColumn("route", F.when(good, "done").when(F.col(receives) >= max_receive, "dead").otherwise("retry"))
