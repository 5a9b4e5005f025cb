"""Runs a registered query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import datetime as dt
import glob
import os
from collections import Counter

import duckdb


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, fn, sql):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = bag(df.columns, got), bag(names, want)
    if a != b:
        only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"rows {len(got)} vs {len(want)}; cols {sorted(names)}\n  spark {only_a}\n  duck  {only_b}"
    types = {n: t for n, t in df.dtypes}
    want_t = {d[0]: str(d[1]) for d in res.description}
    bad = []
    for n, t in types.items():
        k = want_t[n].upper()
        ok = {
            "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
            "boolean": "BOOLEAN",
        }.get(t)
        if ok and k != ok and k not in ("NUMBER", "STRING", "DATETIME", "BOOL"):
            bad.append((n, t, k))
    if bad:
        return f"types {bad}"
    return None if got else "EMPTY"
