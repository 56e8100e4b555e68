"""Compares queries with their SQL in DuckDB: columns, row counts and values."""

import glob
import math
import os

import duckdb


def connect(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p)[:-8]
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{src}'")
    return c


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 6) + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def difference(df, sql, con):
    got_cols = sorted(df.columns)
    got = sorted((tuple(canon(r[c]) for c in got_cols) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != got_cols:
        return f"columns {got_cols} and {sorted(names)}"
    at = [names.index(c) for c in got_cols]
    want = sorted((tuple(canon(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; {got[:2]} {want[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if any(x != y and not (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 1e-9 * max(1, abs(x))) for x, y in zip(a, b))]
    return f"{len(bad)} of {len(got)} rows differ, such as {bad[:2]}" if bad else ""
