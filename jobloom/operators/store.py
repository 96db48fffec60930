"""Stored tables in buckets: a batch writes the buckets that it touches, and a manifest that says which version of each bucket counts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("jobs", "postings", "sources")


@dataclass
class Snapshot:
    """The stored tables: jobs (source_id, user_id, identity, external_id, url, dedup_key, hash, structured, match_score, first_seen, last_seen, and since round 3
    source_type, ats_vendor, raw_text, needs_review), postings (user_id, dedup_key, company_name, company_name_normalized, canonical_title, location_normalized,
    structured, match_score) and sources. elsewhere: user_id, dedup_key of the users' jobs that a snapshot of touched sources leaves out."""

    jobs: DataFrame
    postings: DataFrame
    sources: DataFrame
    elsewhere: DataFrame | None = None


class SnapshotStore:
    """Versions of the stored tables under a shared folder.

    A user's rows are in one of `buckets` user buckets, its jobs and sources there in one of `parts` by source. A batch reads the parts of the
    sources that it touches and the postings of their users, of the users' other jobs only the keys (an orphan is told by all jobs of its user); it writes those parts and
    postings, under its own number; everything else stays where it is. The manifest of a batch, buckets * (2 * parts + 1) rows at most, is written last: a batch that is
    run again after a failure starts from the manifest before its own and replaces its own files. `expire` deletes files that no kept manifest names.
    """

    def __init__(self, spark: SparkSession, base: str, buckets: int = 64, parts: int = 8):
        self.spark, self.base, self.buckets, self.parts = spark, base, buckets, parts

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _user(self) -> Column:
        return F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int")

    def _bucket(self, table: str) -> Column:
        part = F.lit(0) if table == "postings" else F.pmod(F.xxhash64("source_id"), F.lit(self.parts)).cast("int")
        return self._user() * self.parts + part

    def batches(self) -> list[int]:
        """Numbers of the complete batches, ascending."""
        found = (re.fullmatch(r"batch=(-?\d+)", n) for n in self._names(f"{self.base}/manifest"))
        return sorted(int(m[1]) for m in found if m and "_SUCCESS" in self._names(f"{self.base}/manifest/{m[0]}"))

    def _manifest(self, batch: int) -> dict[tuple[str, int], int]:
        return {(r["name"], r["bucket"]): r["version"] for r in self.spark.read.parquet(f"{self.base}/manifest/batch={batch}").collect()}

    def _last(self, batch: int) -> int:
        earlier = [b for b in self.batches() if b < batch]
        if not earlier:
            raise ValueError("the store holds no snapshot")
        return earlier[-1]

    def _read(self, manifest: dict, table: str, wanted: Callable[[int], bool] = lambda bucket: True) -> DataFrame:
        paths = [f"{self.base}/{table}/batch={v}/bucket={b}" for (name, b), v in sorted(manifest.items()) if name == table and wanted(b)]
        schema = self.spark.read.parquet(f"{self.base}/schema/{table}").schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _touched(self, manifest: dict, touched: DataFrame) -> DataFrame:
        return self._read(manifest, "sources").select("source_id", "user_id").join(touched.select("source_id").distinct(), "source_id", "left_semi")

    def read(self, batch: int) -> Snapshot:
        manifest = self._manifest(batch)
        return Snapshot(*(self._read(manifest, t) for t in TABLES))

    def before(self, batch: int, touched: DataFrame | None = None) -> Snapshot:
        """The last complete snapshot before a batch; if touched sources (source_id) are given, only the jobs of their parts, the postings and sources of their
        user buckets, and the keys of the other jobs there."""
        manifest = self._manifest(self._last(batch))
        if touched is None:
            return Snapshot(*(self._read(manifest, t) for t in TABLES))
        hit = {r[0] for r in self._touched(manifest, touched).select(self._bucket("jobs")).distinct().collect()}
        users = {b // self.parts for b in hit}
        of_users = lambda b: b // self.parts in users
        elsewhere = self._read(manifest, "jobs", lambda b: of_users(b) and b not in hit).select("user_id", "dedup_key")
        return Snapshot(self._read(manifest, "jobs", lambda b: b in hit), self._read(manifest, "postings", of_users), self._read(manifest, "sources", of_users), elsewhere)

    def write(self, batch: int, snapshot: Snapshot, touched: DataFrame | None = None) -> None:
        """Writes a batch's snapshot: whole, or the buckets of the touched sources and their users alone."""
        manifest = {} if touched is None else self._manifest(self._last(batch))
        mine = None if touched is None else self._touched(manifest, touched)
        for table in TABLES:
            rows = getattr(snapshot, table).withColumn("bucket", self._bucket(table))
            if mine is None:
                rows.drop("bucket").limit(0).write.mode("overwrite").parquet(f"{self.base}/schema/{table}")
            else:
                hit = [r[0] for r in mine.select(self._bucket(table)).distinct().collect()]
                rows = rows.filter(F.col("bucket").isin(hit))
                manifest = {k: v for k, v in manifest.items() if k[0] != table or k[1] not in set(hit)}
            # large buckets are split over several tasks and files
            path = f"{self.base}/{table}/batch={batch}"
            rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            manifest |= {(table, int(n[7:])): batch for n in self._names(path) if n.startswith("bucket=")}
        rows = [(name, bucket, version) for (name, bucket), version in manifest.items()]
        self.spark.createDataFrame(rows, "name string, bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/manifest/batch={batch}")

    def expire(self, keep: int = 2) -> int:
        """Deletes manifests but the last `keep`, and bucket versions that none of those names; returns how many folders went. Readers of older snapshots must be done."""
        numbers = self.batches()
        kept = numbers[-keep:]
        named = {(t, v, b) for n in kept for (t, b), v in self._manifest(n).items()}
        gone = [f"{self.base}/manifest/batch={n}" for n in numbers[:-keep]]
        for table in TABLES:
            for folder in self._names(f"{self.base}/{table}"):
                version = int(folder.partition("=")[2])
                if version > kept[-1]:  # a batch at work
                    continue
                buckets = [n for n in self._names(f"{self.base}/{table}/{folder}") if n.startswith("bucket=")]
                left = [n for n in buckets if (table, version, int(n[7:])) in named]
                gone += [f"{self.base}/{table}/{folder}/{n}" for n in buckets if n not in left] if left else [f"{self.base}/{table}/{folder}"]
        for path in gone:
            fs, p = self._fs(path)
            fs.delete(p, True)
        return len(gone)
