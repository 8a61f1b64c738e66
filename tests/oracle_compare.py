"""Differential check of a registered query against its DuckDB SQL.

Mirrors the driver's gate: row count, column names, and an order-insensitive comparison of the
values with the columns sorted by name.  Values are compared exactly; floats additionally with
a relative tolerance so that a failure report tells "different rows" from "last-bit noise".
"""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item") and not isinstance(v, (list, dict)):
        try:
            return v.item()
        except Exception:
            return v
    return v


def _rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    rows.sort(key=lambda r: tuple((x is None, str(x)) for x in r))
    return cols, rows


def _close(a, b, rel=1e-9):
    if isinstance(a, float) and isinstance(b, (float, int)):
        return math.isclose(a, b, rel_tol=rel, abs_tol=1e-9)
    if isinstance(b, float) and isinstance(a, int):
        return math.isclose(a, b, rel_tol=rel, abs_tol=1e-9)
    return a == b


def compare(spark_df, con, sql: str) -> dict:
    s = spark_df.toPandas()
    d = con.execute(sql).df()
    out = {"spark_rows": len(s), "oracle_rows": len(d)}
    sc, sr = _rows(s)
    dc, dr = _rows(d)
    out["columns_match"] = sc == dc
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = sc, dc
        out["exact"] = out["approx"] = False
        return out
    out["exact"] = sr == dr
    approx = len(sr) == len(dr) and all(
        all(_close(a, b) for a, b in zip(x, y)) for x, y in zip(sr, dr)
    )
    out["approx"] = approx
    if not approx:
        diff = [(x, y) for x, y in zip(sr, dr) if not all(_close(a, b) for a, b in zip(x, y))]
        out["first_diff"] = diff[:3]
    return out
