"""Compares a query's rows with those DuckDB gives for its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

SPARK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "double": "DOUBLE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _sortable(row: tuple) -> tuple:
    return tuple((value is None, str(value)) for value in row)


def differences(frame: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs in columns, types or rows; empty when nothing does."""
    relation = connection.sql(sql)
    names = sorted(frame.columns)
    if names != sorted(relation.columns):
        return f"columns {names} against {sorted(relation.columns)}"
    mine = {f.name: SPARK_TYPES[f.dataType.simpleString()] for f in frame.schema}
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    if mine != theirs:
        return f"types {mine} against {theirs}"
    left = sorted((tuple(r) for r in frame.select(*names).collect()), key=_sortable)
    right = sorted(relation.select(*[f'"{n}"' for n in names]).fetchall(), key=_sortable)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for ours, other in zip(left, right):
        if ours != other:
            return f"row {ours} against {other}"
    return ""
