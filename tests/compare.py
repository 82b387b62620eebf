"""Rows of a Spark query against rows of DuckDB, without order, floats to six digits."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def same(df, con, sql):
    columns = sorted(df.columns)
    mine = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = ordered(tuple(plain(r[i]) for i in at) for r in got.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
