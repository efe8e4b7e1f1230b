"""Run registered queries beside their SQL and compare rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x + 0.0, 9)
    return x


def normal(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(con, df, sql: str) -> str:
    """Empty if equal, else what differs."""
    cursor = con.execute(sql)
    names, kinds = [d[0] for d in cursor.description], {d[0]: str(d[1]) for d in cursor.description}
    want = normal(names, cursor.fetchall())
    got = normal(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    if len(want) != len(got):
        return f"{len(got)} rows and {len(want)}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} and {b} of {sorted(names)}"
    alike = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if alike.get(t, kinds[c]) != kinds[c] or t not in alike}
    return f"types {odd}" if odd else ""
