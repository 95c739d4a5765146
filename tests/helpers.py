"""Comparing Spark results with DuckDB and with plain Python."""

from __future__ import annotations

import math
import os


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in sorted(v.asDict().items()))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "__iter__"):
        return tuple(plain(x) for x in v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{float(v):.9g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df):
    """Sorted rows of a Spark DataFrame, columns by name."""
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(sf: str, sql: str):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf):
        path = f"{sf}/{f}/*.parquet" if os.path.isdir(f"{sf}/{f}") else f"{sf}/{f}"
        c.execute(f"create view {f.split('.')[0]} as select * from '{path}'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    at = [names.index(n) for n in cols]
    return cols, sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
