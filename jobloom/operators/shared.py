"""Shared folders and positions in one order."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is named: a fresh local one on a single machine, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-shared-")


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with consecutive positions from 0 in a total order, without a window over all rows.

    Ranges of the order are sorted apart. One count a range, as many as spark.sql.shuffle.partitions at most, meets on
    the driver and goes back as a literal map.
    """
    placed = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, row = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect()):
        offsets.append((p, before))
        before += n
    table = df.sparkSession.createDataFrame(offsets, "_p long, _before long")
    return placed.withColumn("_p", part).join(table, "_p").withColumn(name, F.col("_before") + row).drop("_m", "_p", "_before")
