"""Results of Spark and DuckDB, brought to one form."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def plain(v):
    if v is None:
        return None
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def connect(folder: str):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return con


def from_spark(df):
    columns = sorted(df.columns)
    return columns, Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def from_duckdb(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), Counter(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())
