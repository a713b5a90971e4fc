"""Compare a registered query with its check SQL in DuckDB."""

import datetime as dt
import time
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    return v


def kind(v):
    return "num:" + type(v).__name__ if isinstance(v, (int, float, Decimal)) else type(v).__name__


def key(row):
    return tuple((x is None, str(type(x)), x if not isinstance(x, (list, dict)) else str(x)) for x in row)


def compare(spark, con, sf, name, fn, sql):
    t = time.time()
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return "rows", len(got), took, ""
    t = time.time()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    raw = rel.fetchall()
    sql_took = time.time() - t
    if sorted(names) != cols:
        return "COLUMNS", len(got), took, f"{cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in order) for r in raw]
    kinds_got = {c: {kind(x[i]) for x in got if x[i] is not None} for i, c in enumerate(cols)}
    kinds_want = {c: {kind(x[i]) for x in want if x[i] is not None} for i, c in enumerate(cols)}
    bad = {c: (kinds_got[c], kinds_want[c]) for c in cols if kinds_got[c] != kinds_want[c]}
    note = f"types {bad}" if bad else ""
    a, b = sorted(got, key=key), sorted(want, key=key)
    if a != b:
        sa, sb = set(map(str, a)), set(map(str, b))
        only_a, only_b = sorted(sa - sb)[:3], sorted(sb - sa)[:3]
        return "DIFF", len(got), took, f"{len(a)} vs {len(b)} rows; cols {cols}\n   spark {only_a}\n   sql   {only_b} {note}"
    return ("ok" if not bad else "TYPES"), len(got), took, note + (f" (sql {sql_took:.0f}s)" if sql_took > 20 else "")
