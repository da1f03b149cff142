"""Compare a query with its SQL on the same Parquet tables, as multisets of rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz",
    "BOOLEAN": "boolean", "FLOAT": "float", '"NULL"': "void",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        if (Path(folder) / f"{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _canonical(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_canonical(r[i]) for i in order) for r in rows)


def differences(df, sql: str, connection) -> list[str]:
    """Empty when names, types and rows agree."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected_types = {d[0]: TYPES.get(str(d[1]).upper(), str(d[1])) for d in cursor.description}
    expected = _rows(names, cursor.fetchall())
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} instead of {sorted(names)}"]
    actual_types = dict(df.dtypes)
    for n in names:
        if actual_types[n] != expected_types[n]:
            found.append(f"type of {n} is {actual_types[n]} instead of {expected_types[n]}")
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(actual) != len(expected):
        found.append(f"{len(actual)} rows instead of {len(expected)}")
    elif actual != expected:
        i = next(i for i, (a, b) in enumerate(zip(actual, expected)) if a != b)
        n = sum(a != b for a, b in zip(actual, expected))
        found.append(f"{n} rows differ, first: {actual[i]} instead of {expected[i]}")
    return found
