"""Compare a Spark result with DuckDB's: names, types, and all rows."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def cell(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def bag(rows, order):
    return Counter(tuple(cell(row[i]) for i in order) for row in rows)


def differences(df, db, sql) -> list[str]:
    """What differs, in words; empty when nothing does."""
    result = db.execute(sql)
    columns = [(c[0], str(c[1])) for c in result.description]
    theirs = {name: type for name, type in columns}
    ours = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if ours != theirs:
        return [f"schema: {ours} vs {theirs}"]
    names = sorted(ours)
    a = bag(df.collect(), [df.columns.index(n) for n in names])
    b = bag(result.fetchall(), [[c[0] for c in columns].index(n) for n in names])
    if a == b:
        return []
    return [f"rows: {a.total()} vs {b.total()}", f"only ours {list((a - b).items())[:3]}", f"only theirs {list((b - a).items())[:3]}"]
