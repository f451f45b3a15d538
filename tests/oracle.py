"""Compares a query with its DuckDB text: columns by name, rows as a multiset of plain values."""

import collections
import datetime
import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else int(v) if v == int(v) and abs(v) < 1e15 else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def compare(df, con, sql):
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0], f"columns {got[0]} and {want[0]}"
    only, lacking = got[1] - want[1], want[1] - got[1]
    assert not only and not lacking, f"{sum(got[1].values())} and {sum(want[1].values())} rows; only Spark {list(only.items())[:3]}; only SQL {list(lacking.items())[:3]}"
