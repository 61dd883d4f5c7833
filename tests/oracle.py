"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        where = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{where}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> int:
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(names, found.fetchall())
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
    return len(mine)
