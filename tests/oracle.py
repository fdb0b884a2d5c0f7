"""Compares a registered query with its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v != int(v) else str(int(v))
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, connection, query, sql, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = connection.execute(sql)
    theirs = rows_of([x[0] for x in found.description], found.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} {theirs[0]}"
    if ours[1] != theirs[1]:
        a = [r for r in ours[1] if r not in set(theirs[1])][:3]
        b = [r for r in theirs[1] if r not in set(ours[1])][:3]
        return f"{len(ours[1])} and {len(theirs[1])} rows; only ours {a}; only SQL {b}"
    return ""
