"""Compare a Spark result with DuckDB's of the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return str(v)
        return f"{v:.9g}"

    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


def expect_equal(df, sql: str, sf_dir: str) -> int:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    found = con.execute(sql)
    wanted = rows_of([c[0] for c in found.description], found.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == wanted[0]
    assert got[1] == wanted[1]
    return len(got[1])
