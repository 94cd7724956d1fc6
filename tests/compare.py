"""Comparison of Spark rows with DuckDB rows."""

import os

import duckdb
import pandas as pd

#: Folder of the smallest shared tables.
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            connection.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    return connection


def cell(v) -> str:
    if isinstance(v, (list, tuple)) or hasattr(v, "shape"):
        return str([cell(x) for x in v])
    if pd.isna(v):
        return "null"
    kind = type(v).__name__
    if kind.startswith(("float", "Decimal")):
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    if kind.startswith(("int", "bool")):
        return str(int(v))
    return str(v)


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))
