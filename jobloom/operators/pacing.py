"""Order-dependent rules in closed form over running sums and maxima: streaks, fixed windows, pacing. A hot key spreads over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import in_ranges, running
from .shared import positions


def failure_streak(runs: DataFrame, key: str, order: list[str], ok: Column) -> DataFrame:
    """runs with `streak`: failures in a row up to and with this run; 0 on success: failures so far less those up to the last success."""
    placed = running(in_ranges(runs.withColumn("_ok", ok), [key], order), [key], order, {"_failed": F.when(~F.col("_ok"), 1)})
    placed = running(placed, [key], order, maxima={"_cleared": F.when(F.col("_ok"), F.col("_failed"))})
    return placed.select(*runs.columns, (F.col("_failed") - F.coalesce("_cleared", F.lit(0))).alias("streak"))


def fixed_window_limit(hits: DataFrame, key: list[str], seconds_col: Column, order: list[str], limit: int, seconds: int, name: str = "allowed") -> DataFrame:
    """hits with a flag: among the first `limit` of its key in its window of epoch-aligned seconds; refused hits count too."""
    placed = in_ranges(hits.withColumn("_window", F.floor(seconds_col / seconds)), [*key, "_window"], order)
    return running(placed, [*key, "_window"], order, {"_nth": F.lit(1)}).select(*hits.columns, (F.col("_nth") <= limit).alias(name))


def pace(requests: DataFrame, host: str, arrival: str, order: list[str], interval: Column) -> DataFrame:
    """requests with `start` (seconds): at arrival, but at least the request's interval after the start before it on the host.

    With D the running sum of intervals, start = D + max over the requests so far of (arrival - D); the first interval cancels out.
    """
    placed = running(in_ranges(requests.withColumn("_gap", interval), [host], order), [host], order, {"_d": F.col("_gap")})
    placed = running(placed, [host], order, maxima={"_m": F.col(arrival) - F.col("_d")})
    return placed.select(*requests.columns, (F.col("_d") + F.col("_m")).alias("start"))


def ranked(rows: DataFrame, score: str, tie: list[Column]) -> DataFrame:
    """rows with `rank` (from 1) by score, highest first, unscored last. Ranges of the order are sorted apart."""
    return positions(rows, [F.col(score).desc_nulls_last(), *tie], "rank").withColumn("rank", F.col("rank") + 1)


def newest_first(rows: DataFrame, ts: str, tie: list[Column]) -> DataFrame:
    """rows from the latest on; Spark sorts by ranges."""
    return rows.orderBy(F.col(ts).desc_nulls_last(), *tie)


def seen_range(rows: DataFrame, key: list[str], ts: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
