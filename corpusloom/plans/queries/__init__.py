"""Registered queries: name to (Spark query, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans.queries import corpus, dedup, flow, records, tables, text, vectors

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> dict[str, tuple[Query, str | None]]:
    """All queries; names are unique over the modules."""
    found: dict[str, tuple[Query, str | None]] = {}
    for module in (vectors, text, corpus, dedup, tables, flow, records):
        for name, entry in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = entry
    return found
