"""Compare a query with its DuckDB SQL as the driver does: columns by name, rows in any order."""

import math
from pathlib import Path

import duckdb


def connect(d):
    con = duckdb.connect()
    for p in Path(d).iterdir():
        at = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(spark, d, query, sql):
    got = query(spark, d)
    want = connect(d).execute(sql)
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table([c[0] for c in want.description], want.fetchall())
