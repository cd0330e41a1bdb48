from __future__ import annotations

import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from corpusloom.session import session, ship_package  # noqa: E402

TESTDATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    made = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__sql__warehouse__dir="/tmp/corpusloom-test-warehouse",
    )
    made.sparkContext.setLogLevel("ERROR")
    ship_package(made)
    yield made
    made.stop()


@pytest.fixture(scope="session")
def folder():
    return TESTDATA
