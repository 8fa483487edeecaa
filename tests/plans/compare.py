"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path


def normal(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted([tuple(normal(r[k]) for k in order) for r in values], key=repr)


def connection(folder: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def compare(spark, con, folder: str, query, sql: str) -> str:
    """Empty where equal, else what differs."""
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    want = rows(names, out.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    return next((f"{g} against {w}" for g, w in zip(got, want) if g != w), "")
