"""Compare a query's rows with those of its SQL on the same tables."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def norm(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)


def expected(sql: str, data: str = DATA) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(names)
    return order, sorted(tuple(norm(r[names.index(n)]) for n in order) for r in cur.fetchall())


def actual(df) -> tuple[list[str], list[tuple]]:
    order = sorted(df.columns)
    return order, sorted(tuple(norm(r[n]) for n in order) for r in df.collect())
