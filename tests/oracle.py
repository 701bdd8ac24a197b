"""Runs a registered query and its SQL on the same tables and compares rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else str(p) + '/*.parquet'}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    return value


def compare(spark, name: str, query, sql: str, folder: str) -> str:
    """Empty when both give the same columns and rows, else what differs."""
    df = query(spark, folder)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = connect(folder).execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != columns:
        return f"{name}: columns {columns} against {sorted(names)}"
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if mine == theirs:
        return ""
    a, b = set(map(repr, mine)), set(map(repr, theirs))
    return f"{name}: {len(mine)} rows against {len(theirs)}; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
