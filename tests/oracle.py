"""Comparing a query with its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def canonical(df) -> list[tuple]:
    def cell(v):
        if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
            return "∅"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.9g}"
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in row) for row in df.astype(object).values.tolist())


def compare(query, sql: str, spark, folder: str) -> None:
    got = query(spark, folder).toPandas()
    want = connect(folder).execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
