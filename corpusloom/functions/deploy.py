"""Functions that users deploy by name and call from SQL or DataFrames."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import PySparkException

NAME = re.compile(r"[a-z_][a-z0-9_]*")
LANGUAGES = ("sql",)
RESULT = "success boolean, function_name string, error string, created_at timestamp"


def deploy_function(
    spark: SparkSession,
    name: str,
    body: str,
    params: str = "",
    return_type: str = "STRING",
    language: str = "sql",
    replace: bool = True,
) -> DataFrame:
    """Create a session function from an SQL expression or, for ``TABLE(...)``, a query.

    Returns one row; a failure is reported in it and not raised.
    """
    error = None
    if not NAME.fullmatch(name):
        error = "Invalid function name: must be lowercase alphanumeric with underscores"
    elif language not in LANGUAGES:
        error = f"Only {', '.join(LANGUAGES)} functions are allowed"
    elif not replace and spark.catalog.functionExists(name):
        error = f"function {name} already exists"
    else:
        create = "CREATE OR REPLACE" if replace else "CREATE"
        try:
            spark.sql(f"{create} TEMPORARY FUNCTION {name}({params}) RETURNS {return_type} RETURN {body}")
        except PySparkException as failure:
            error = str(failure)
    created = None if error else datetime.now(timezone.utc)
    return spark.createDataFrame([(error is None, name, error, created)], RESULT)


def call_function(spark: SparkSession, name: str, **args: object) -> DataFrame:
    """Call a deployed function with named arguments; one row, one column ``result``."""
    if not NAME.fullmatch(name):
        raise ValueError(f"not a function name: {name!r}")
    named = ", ".join(f"{key} => :{key}" for key in args)
    return spark.sql(f"SELECT {name}({named}) AS result", args=args)


def call_table_function(spark: SparkSession, name: str, **args: object) -> DataFrame:
    """Rows of a deployed table function."""
    if not NAME.fullmatch(name):
        raise ValueError(f"not a function name: {name!r}")
    named = ", ".join(f"{key} => :{key}" for key in args)
    return spark.sql(f"SELECT * FROM {name}({named})", args=args)
