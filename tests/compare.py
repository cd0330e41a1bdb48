"""Comparison of a Spark result with the SQL result on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark_df, connection, sql: str) -> str | None:
    """A short text if the results differ in columns, types of values or rows."""
    relation = connection.execute(sql)
    wanted_columns = [c[0] for c in relation.description]
    wanted = relation.fetchall()
    if sorted(spark_df.columns) != sorted(wanted_columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(wanted_columns)}"
    found = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    wanted = rows_of(wanted_columns, wanted)
    if len(found) != len(wanted):
        return f"{len(found)} rows vs {len(wanted)}"
    for a, b in zip(found, wanted):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a!r:.400} vs {b!r:.400}"
    return None
