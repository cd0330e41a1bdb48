"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from compare import connect, difference
from corpusloom.plans.queries import registry

CORE = set(registry())
QUERIES = {name: query for name, query in entry_points.queries().items() if name in CORE}
SQL = {name: sql for name, sql in entry_points.oracle_sql().items() if name in CORE}

# joins that compare all pairs, and row-at-a-time Python
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


def test_every_query_has_sql():
    """Queries for training data are tested in their own folder."""
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert [r.vec_id for r in rows] == [0, 17, 59, 248, 262]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, folder, connection, name):
    frame = QUERIES[name](spark, folder)
    assert difference(frame, connection, SQL[name]) is None
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan], plan
