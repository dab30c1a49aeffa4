"""Comparing a Spark result with the SQL result over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def sql_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    result = connection.execute(sql)
    return [c[0] for c in result.description], result.fetchall()


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def ordered(columns: list[str], rows) -> list[tuple]:
    """Rows with columns by name, in an order that does not depend on the engine."""
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in places) for row in rows]
    return sorted(plain, key=lambda row: [(value is not None, str(value)) for value in row])
