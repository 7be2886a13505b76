"""Comparison of a query with its SQL: same columns, same rows in any order, doubles to 1e-6."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    return value


def difference(df, con, sql: str) -> str:
    names = sorted(df.columns)
    found = con.execute(sql)
    theirs = [c[0] for c in found.description]
    if sorted(theirs) != names:
        return f"columns {names} and {sorted(theirs)}"
    order = [theirs.index(n) for n in names]
    b = sorted((tuple(plain(row[k]) for k in order) for row in found.fetchall()), key=repr)
    a = sorted((tuple(plain(row[n]) for n in names) for row in df.collect()), key=repr)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {bad[:3]}" if bad else ""
