"""Stored tables laid out for what is asked of them: folders by user, buckets by identity.

A tenant's rows are read from one folder, and two tables in the same buckets, or a batch and a table, are joined and
counted without moving the stored rows. Buckets go by the whole identity, so a source or a user with a third of all rows
fills all buckets evenly.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "user_folder"


@dataclass(frozen=True)
class Layout:
    """keys: the identity that buckets go by; user: the column that folders go by, if any. Two tables meet in place if their keys and buckets are equal."""

    keys: tuple[str, ...]
    buckets: int = 64
    user: str | None = None
    folders: int = 64

    def _folder(self, value) -> F.Column:
        return F.pmod(F.xxhash64(value), F.lit(self.folders)).cast("int")

    def write(self, rows: DataFrame, path: str, name: str | None = None) -> DataFrame:
        """Stores rows as an external table at path and returns it; each task writes one bucket, so a folder has a file a bucket at most.

        Rows of a null user have a folder, those of null keys a bucket, as other values do; a column of rows called `user_folder` is refused.
        Without a name the table gets one of its own; whoever needs it no more drops the table and deletes the path.
        """
        if self.user and FOLDER in rows.columns:
            raise ValueError(f"the layout needs the name {FOLDER}")
        out = rows.withColumn(FOLDER, self._folder(F.col(self.user))) if self.user else rows
        name = name or f"layout_{uuid.uuid4().hex}"
        # the same hash as the buckets': a task is a bucket
        writer = out.repartition(self.buckets, *self.keys).write.format("parquet").option("path", path).bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        (writer.partitionBy(FOLDER) if self.user else writer).saveAsTable(name)
        return self.read(rows.sparkSession, name)

    def attach(self, spark: SparkSession, name: str, path: str, schema: str) -> DataFrame:
        """A stored table, of which only the files are there, under a name in this session; schema: its columns without the folder's."""
        columns = schema + (f", {FOLDER} int" if self.user else "")
        keys = ", ".join(f"`{k}`" for k in self.keys)
        by = f"PARTITIONED BY ({FOLDER})" if self.user else ""
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {by} CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        if self.user:
            spark.sql(f"MSCK REPAIR TABLE {name}")
        return self.read(spark, name)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.table(name)

    def scoped(self, stored: DataFrame, value) -> DataFrame:
        """A tenant's own rows, from the tenant's folder alone; null is nobody's and has none."""
        user = F.lit(value).cast(stored.schema[self.user].dataType)
        return stored.filter((F.col(FOLDER) == self._folder(user)) & (F.col(self.user) == user)).drop(FOLDER)


def stale_stored(held: DataFrame, survivors: DataFrame, complete_runs: DataFrame, keys: list[str], run_key: str) -> DataFrame:
    """As `stale_rows` for tables in buckets of keys: identities meet in place first, and what did not survive alone is moved to its source's run."""
    gone = held.join(survivors.select(*keys), keys, "left_anti")
    return gone.join(complete_runs.select(run_key).distinct(), run_key, "left_semi")
