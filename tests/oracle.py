"""Runs a query and its SQL over the same tables and compares the rows."""

import datetime
import decimal
import math
import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    for t in os.listdir(folder):
        path = f"{folder}/{t}"
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())


def sql_rows(con, sql):
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(repr(tuple(plain(r[i]) for i in order)) for r in cursor.fetchall())
