"""Compare a registered query with its SQL run by DuckDB on the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{Path(sf_dir) / table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if columns, rows and values agree, else what differs."""
    names, rows = _rows(df.columns, df.collect())
    found = con.execute(sql)
    other_names, other_rows = _rows([d[0] for d in found.description], found.fetchall())
    if names != other_names:
        return f"columns {names} against {other_names}"
    if len(rows) != len(other_rows):
        return f"{len(rows)} rows against {len(other_rows)}"
    if not rows:
        return "no rows"
    for mine, other in zip(rows, other_rows):
        if mine != other or [type(a) for a in mine] != [type(b) for b in other]:
            return f"{mine} against {other}"
    return None
