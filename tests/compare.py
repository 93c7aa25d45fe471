"""Rows of a query held against rows of SQL over the same tables."""

import os

import duckdb
import math

DATA = os.environ.get("QUILLSPARK_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in records)


def sql_rows(sql, folder=DATA, **tables):
    con = duckdb.connect()
    for name in TABLES:
        if name not in tables:
            con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    for name, frame in tables.items():
        con.register(name, frame)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return sorted(columns), rows(columns, found.fetchall())


def same(df, sql, folder=DATA, **tables):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    columns, expected = sql_rows(sql, folder, **tables)
    assert sorted(df.columns) == columns
    assert got == expected
