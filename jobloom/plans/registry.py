"""Queries by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Epoch seconds of a zone-less time, read as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def wide(c: Column) -> Column:
    """A text in full-width characters, which compatibility folding turns back."""
    narrow = "".join(map(chr, range(0x21, 0x7F)))
    return F.translate(c, " " + narrow, "\u3000" + "".join(chr(ord(x) + 0xFEE0) for x in narrow))
