"""Run a query and its SQL twin and compare rows, columns and values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import time
from collections import Counter

import duckdb
import numpy as np

from tidemark.sources.tables import TABLES


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (float, np.floating)):
        if math.isnan(v):
            return "NaN"
        v = float(v)
        return 0.0 if v == 0 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        if hasattr(v, "asDict"):
            return tuple(sorted((k, canon(x)) for k, x in v.asDict().items()))
        return tuple(canon(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], [tuple(canon(r[i]) for i in order) for r in rows]


def compare(spark, name, fn, sql, folder, con):
    t0 = time.time()
    df = fn(spark, folder)
    got = df.collect()
    took = time.time() - t0
    gcols, grows = rows_of(df.columns, got)
    if sql is None:
        return None, took, f"rows={len(grows)}"
    cur = con.execute(sql)
    wcols, wrows = rows_of([d[0] for d in cur.description], cur.fetchall())
    if gcols != wcols:
        return False, took, f"columns {gcols} != {wcols}"
    if len(grows) != len(wrows):
        return False, took, f"rows {len(grows)} != {len(wrows)}"
    a, b = Counter(grows), Counter(wrows)
    if a == b:
        return True, took, f"rows={len(grows)}"
    left, right = list((a - b).elements()), list((b - a).elements())
    key = lambda t: tuple(str(x) for x in t)
    left.sort(key=key), right.sort(key=key)
    return False, took, f"rows={len(grows)} differ={len(left)} cols={gcols}\n   spark {left[:3]}\n   sql   {right[:3]}"
