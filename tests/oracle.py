"""Spark-vs-DuckDB comparison shared by the parity tests."""

import math
import os

import duckdb

from leadlens.sources.tables import DRIVER_TABLES


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return float(f"{float(v):.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, type(x).__name__ if x is not None else "", x if x is not None else 0) for x in row)


def duck(sf_dir):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def compare(df, con, sql):
    cols = df.columns
    s = sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()], key=_key)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == sorted(cols), (cols, dcols)
    idx = [dcols.index(c) for c in cols]
    d = sorted([tuple(norm(r[i]) for i in idx) for r in res.fetchall()], key=_key)
    assert len(s) == len(d), (len(s), len(d))
    assert s == d, [(a, b) for a, b in zip(s, d) if a != b][:3]
    return len(s)
