"""Compare a registered query with its expected result."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _cell(value):
    """Sortable form; NaN equals nothing, so it is spelled out."""
    if value is None:
        return ("0", "")
    if isinstance(value, float):
        return ("1", "nan") if math.isnan(value) else ("1", repr(value + 0.0))
    return ("1", repr(value))


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(actual: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    expected = connection.execute(sql)
    names = [column[0] for column in expected.description]
    if sorted(names) != sorted(actual.columns):
        return [f"columns {sorted(actual.columns)} instead of {sorted(names)}"]
    expected_rows = rows_of(names, expected.fetchall())
    actual_rows = rows_of(actual.columns, actual.collect())
    if len(actual_rows) != len(expected_rows):
        return [f"{len(actual_rows)} rows instead of {len(expected_rows)}"]
    return [
        f"{a} instead of {e}" for a, e in zip(actual_rows, expected_rows, strict=True) if a != e
    ]
