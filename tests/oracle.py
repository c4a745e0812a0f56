"""Side by side: a query in Spark and its SQL in DuckDB."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")


def connection():
    import duckdb

    c = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        target = f"{path}/*.parquet" if path.is_dir() else str(path)
        c.execute(f"create view {path.stem} as select * from '{target}'")
    return c


def _plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if isinstance(x, list):
        return tuple(x)
    return x if x is None or isinstance(x, (int, str, bool)) else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, query, sql, c):
    df = query(spark, str(DATA))
    got = rows_of(df.columns, df.collect())
    c.execute(sql)
    want = rows_of([d[0] for d in c.description], c.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
