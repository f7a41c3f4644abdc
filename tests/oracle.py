"""Run a query and its SQL side by side."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or (not isinstance(x, (list, tuple)) and pd.isna(x)):
            return ""
        if isinstance(x, float):
            return f"{x:.6f}".rstrip("0").rstrip(".") if x else "0"
        return str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(x) for x in row) for row in df.astype(object).itertuples(index=False, name=None))


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if both have the same columns and rows."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return ""
    more, less = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{len(a)} and {len(b)} rows; only in the query {more}; only in the SQL {less}"
