"""Side-by-side check of a registered query against its DuckDB oracle SQL:
row count, column names and an order-insensitive hash of the values."""

from __future__ import annotations

import hashlib
import math

import duckdb
import pandas as pd

from sieve.plans.fixtures import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        return _norm(v.item())
    try:
        from decimal import Decimal
        if isinstance(v, Decimal):
            return _norm(float(v))
    except Exception:
        pass
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def digest(df: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(v) for v in rec) for rec in df[cols].itertuples(index=False, name=None))
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(rows), cols, h


def compare(spark, name: str, fn, sql: str, sf_dir: str):
    sdf = fn(spark, sf_dir)
    # Values as they are: pandas would make floats of whole numbers beside nulls.
    got = pd.DataFrame(list(map(tuple, sdf.collect())), columns=sdf.columns, dtype=object)
    found = duck(sf_dir).execute(sql)
    exp = pd.DataFrame(found.fetchall(), columns=[c[0] for c in found.description], dtype=object)
    return digest(got), digest(exp), got, exp
