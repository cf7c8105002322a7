"""Compare a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


def connect(folder: str = FOLDER) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in os.listdir(folder):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{folder}/{t}'")
    return c


def same_rows(df, sql: str, folder: str = FOLDER) -> None:
    cursor = connect(folder).execute(sql)
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = Counter(tuple(value(dict(zip(columns, r, strict=True))[c]) for c in order) for r in cursor.fetchall())
    got = Counter(tuple(value(r[c]) for c in order) for r in df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
