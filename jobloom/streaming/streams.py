"""Streaming forms of the keyed rules: same answers as the batch forms on logs in time order.

State is one small row a key, evicted by event-time timers once it can no longer matter; within a micro-batch a
key's events are taken in time order. Events that come behind their key's judged ones or the watermark are given back as
late (`processors.py`). With `buckets`, keys of a bucket share a state and a call: for many keys with few rows each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import Scorer, SnapshotStore, batch_usage, ingest_batch
from ..operators.shared import settled, shared_folder
from .processors import STATE_STORE, Attempts, Processed, Sessions, Streaks, judged


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    """Event files as a stream with event time `ts`; at most so many files a batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    # as a pattern of one name: a stream takes a pattern for a table of one file as well as for a folder
    literal = re.sub(r"([\[\]{}*?\\])", r"\\\1", path.rstrip("/"))
    return reader.parquet(f"{literal[:-1]}[{literal[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def drained(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None, base: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its output, written batch by batch to the shared folder, with `batch`.

    A batch's folder is named by its number, so a batch that is run again after a failure replaces its own output; what
    is done is read from the folders, so a restart with the same base goes on. In update mode a later batch's rows stand
    beside the earlier ones they supersede.
    """
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        out = each(batch, number) if each else batch
        out.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    named = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:  # a query takes the session's settings when it starts
        query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE_STORE[0], named)
    query.awaitTermination()
    if not _exists(spark, f"{base}/out"):
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0))
    return spark.read.parquet(f"{base}/out")


def dedupe_stream(events: DataFrame, key: list[str], ttl_seconds: float, delay: str = "1 hour", buckets: int | None = None) -> DataFrame:
    """`event_id, late` of processed events: a key's first, and each at least ttl after the last processed one; and of late ones, which nobody judged."""
    return judged(events, key, "ts", "event_id", Processed(int(ttl_seconds * 1e6)), delay, buckets)


def rate_counts_stream(events: DataFrame, key: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Hits per key and fixed window; refused hits count too. Run in update mode: windows behind the watermark leave the state."""
    counted = events.withWatermark("ts", delay).groupBy(key, F.window("ts", width)).agg(F.count(F.lit(1)).alias("hits"))
    return counted.select(key, F.unix_timestamp("window.start").alias("window_start"), "hits")


def failure_stream(events: DataFrame, key: str, failed: str, max_failures: int = 5, delay: str = "1 hour", buckets: int | None = None) -> DataFrame:
    """`event_id, streak, stopped, late`: failures in a row with each run, and whether that stops the source."""
    return judged(events.withColumn("failed", F.col(failed)), [key], "ts", "event_id", Streaks(max_failures), delay, buckets)


def session_stream(events: DataFrame, key: str, refresh: float, ttl: float, delay: str = "1 hour", buckets: int | None = None) -> DataFrame:
    """`event_id, alive, late`: whether an access finds its session; touches move its end only so often."""
    return judged(events, [key], "ts", "event_id", Sessions(int(refresh * 1e6), int(ttl * 1e6)), delay, buckets)


def latest_counts(updates: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The last of the counts that an update stream gave for its keys; counts only grow."""
    return updates.groupBy(*keys).agg(F.max(count).alias(count))


def attempts_stream(log: DataFrame, key: str, max_attempts: int, ttl: float, delay: str = "1 hour", buckets: int | None = None) -> DataFrame:
    """`event_id, result, late` of verify events, and of late events of any kind: a key's state is its live code, challenge, end and wrong tries."""
    return judged(log, [key], "ts", "event_id", Attempts(max_attempts, int(ttl * 1e6)), delay, buckets)


def ingest_stream(deliveries: DataFrame, store: SnapshotStore, runs_of: Callable[[DataFrame, int], DataFrame], preferences: DataFrame, scorer: Scorer, now: Callable[[int], Column], keep: int | None = 3, **options) -> DataFrame:
    """Runs a stream of fetched postings through ingest_batch, each batch on the snapshot that the one before left; returns the statuses.

    The store's batch -1 is the snapshot to begin with. runs_of gives a batch's run per source; only the buckets of those sources and their users are
    read and written. A batch's usage rows replace those of its own number under `usage`. After each batch all but the last `keep` snapshots expire.
    """

    def each(batch: DataFrame, number: int) -> DataFrame:
        runs = settled(runs_of(batch, number))
        snapshot, statuses = ingest_batch(store.before(number, runs), batch, runs, preferences, scorer, now(number), **options)
        store.write(number, snapshot, runs)
        batch_usage(statuses).write.mode("overwrite").parquet(f"{store.base}/usage/batch={number}")
        if keep:
            store.expire(keep)
        return statuses.select("source_id", "identity", "status", "reason", "match_score", "error")

    return drained(deliveries, each=each)
