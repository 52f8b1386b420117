"""Comparison of a Spark result with DuckDB's, by column name, regardless of order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def _plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(_plain, v))
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return round(float(v), 9)
    return str(pd.Timestamp(v)) if isinstance(v, pd.Timestamp) or hasattr(v, "isoformat") else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(map(_plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)
