"""Compare a catalogue query with its SQL on DuckDB: columns, types, rows and values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if hasattr(value, "as_tuple"):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else format(value + 0.0, ".9g")
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark, con, run, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    frame = run(spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if got == want:
        return None
    a, b = set(got), set(want)
    return f"rows {len(got)} / {len(want)}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"
