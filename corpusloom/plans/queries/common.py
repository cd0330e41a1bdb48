"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.text import WHITESPACE_CLASS, WHITESPACE_CODES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def long(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


# SQL text of the white-space characters and of their regular-expression class
SQL_WS = "(" + "||".join(f"chr({code})" for code in WHITESPACE_CODES) + ")"
SQL_WS_CLASS = WHITESPACE_CLASS


def sql_char_pieces(text: str, size: int = 1600, step: int = 1400) -> str:
    """SQL list of the non-empty stripped character windows of a text expression."""
    stripped = f"trim(coalesce({text}, ''), {SQL_WS})"
    return (
        f"list_filter(list_transform("
        f"CASE WHEN length({stripped}) = 0 THEN [] WHEN length({stripped}) <= {size} THEN [{stripped}] "
        f"ELSE list_transform(range(0, length({stripped}), {step}), "
        f"lambda i: substring({stripped}, i::INT + 1, {size})) END, "
        f"lambda c: trim(c, {SQL_WS})), lambda c: c <> '')"
    )


# One-page documents cut into character windows
SQL_CHUNKS = (
    "pieces AS (SELECT doc_id, lang, source, " + sql_char_pieces("text") + " AS l FROM documents), "
    "chunks AS (SELECT doc_id, lang, source, unnest(l) AS content, generate_subscripts(l, 1) - 1 AS chunk_index FROM pieces)"
)
SQL_TOKENS = "greatest(1, length(content) // 4)"
