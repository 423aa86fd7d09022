"""Run a catalogue query and its oracle and compare them as multisets of rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def spark_rows(df):
    return rows_of(df.columns, df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([x[0] for x in cur.description], cur.fetchall())


def difference(left, right) -> str | None:
    """None when equal, else a short description."""
    if left[0] != right[0]:
        return f"columns differ: {left[0]} / {right[0]}"
    if left[1] == right[1]:
        return None
    a, b = set(left[1]), set(right[1])
    only_l, only_r = sorted(a - b, key=repr)[:3], sorted(b - a, key=repr)[:3]
    return (
        f"{len(left[1])} / {len(right[1])} rows, {len(a - b)} / {len(b - a)} unmatched\n"
        f"  columns {left[0]}\n  spark  {only_l}\n  oracle {only_r}"
    )
