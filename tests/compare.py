"""Run a query and its SQL on the same tables and compare the rows, in any order."""

import datetime
import decimal
import math

import duckdb

from tests.conftest import TABLES


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (bytearray, memoryview)):
        return bytes(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None when equal, else what differs."""
    res = con.execute(sql)
    want_names = [d[0] for d in res.description]
    want = rows_of(want_names, res.fetchall())
    got = rows_of(df.columns, df.collect())
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} against {sorted(want_names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"got {str(g)[:700]}\nwant {str(w)[:700]}"
    return None
