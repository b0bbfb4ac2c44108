"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return None if v is None else str(v)


def differs(spark, f, sql: str, sf_dir: str) -> str:
    """'' if columns and rows agree."""
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{t}')")
    df = f(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    if sorted(names) != columns:
        return f"columns {names} and {columns}"
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    return "" if got == want else f"{len(got)} and {len(want)} rows; {[r for r in got if r not in want][:2]} {[r for r in want if r not in got][:2]}"
