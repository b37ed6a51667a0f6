"""Comparison of a Spark result with DuckDB's over the same tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def _cell(v) -> str:
    if isinstance(v, (list, np.ndarray)):
        return repr([_cell(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return str(round(float(v), 6) + 0.0) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_cell, r)) for r in frame.itertuples(index=False))


def assert_same(got: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(expected.columns)
    a, b = rows(got), rows(expected)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, bad[:3]
