"""Spark results against DuckDB on the same tables, order aside."""

import os

import duckdb
import pandas as pd


def shown(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(map(one, row)) for row in frame[columns].itertuples(index=False, name=None))


def duck(sql: str, sf_dir: str | None = None, **tables: pd.DataFrame) -> pd.DataFrame:
    connection = duckdb.connect()
    if sf_dir:
        for name in os.listdir(sf_dir):
            connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    for name, frame in tables.items():
        connection.register(name, frame)
    return connection.execute(sql).df()
