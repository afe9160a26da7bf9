"""Runs a query in Spark and its SQL in DuckDB and compares rows, whatever their order."""

from __future__ import annotations

import math
from numbers import Real
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(v):
    """Numbers by value, whatever their width; NaN and NA as None."""
    if v is None or v is pd.NA or (isinstance(v, Real) and math.isnan(v)):
        return None
    if not isinstance(v, Real):
        return str(v)
    return int(v) if float(v).is_integer() else float(v)


def rows(frame, columns: list[str]) -> list[tuple]:
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


def difference(spark_frame, duck_frame) -> str:
    """Empty if equal."""
    a, b = spark_frame.toPandas(), duck_frame.df()
    columns = sorted(a.columns)
    if columns != sorted(b.columns):
        return f"columns {columns} and {sorted(b.columns)}"
    x, y = rows(a, columns), rows(b, columns)
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows; {[r for r in x if r not in set(y)][:3]} {[r for r in y if r not in set(x)][:3]}"
    wrong = [(r, s) for r, s in zip(x, y) if r != s]
    return f"{len(wrong)} of {len(x)} rows differ: {wrong[:3]}" if wrong else ""
