"""Declared table schemas and the check of tables before work starts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# The closed list of logical column types.
LOGICAL_TYPES = ["string", "number", "datetime", "vector", "seqnumber", "jsonb"]


def _spark_type(logical: str) -> T.DataType:
    return {
        "string": T.StringType(),
        "number": T.DecimalType(38, 18),
        "datetime": T.TimestampNTZType(),
        "vector": T.ArrayType(T.FloatType(), containsNull=False),
        "seqnumber": T.LongType(),
        "jsonb": T.VariantType(),
    }[logical]


def declare_schema(
    table: str,
    columns: dict[str, str] | str,
    primary_key: list[str] | None = None,
    dims: int = 2560,
) -> T.StructType:
    """Schema of a declared table; columns keep their order.

    ``columns`` maps names to logical types, as a dict or a JSON object. The logical
    type, the vector size and the place in the primary key are column metadata.
    """
    if not (table or "").strip():
        raise ValueError("Table name (name) is required in JSON definition")
    if isinstance(columns, str):
        columns = json.loads(columns)
    if not isinstance(columns, dict):
        raise ValueError("columns must be a JSON object of name:type pairs")
    key = list(primary_key or [])
    for name in key:
        if name not in columns:
            raise ValueError(f'column "{name}" named in key does not exist')
    fields = []
    for name, declared in columns.items():
        logical = str(declared).lower()
        if logical not in LOGICAL_TYPES:
            raise ValueError(
                f'Unsupported type "{declared}" for column "{name}". Supported: {", ".join(LOGICAL_TYPES)}'
            )
        meta: dict[str, object] = {"logical": logical}
        if logical == "vector":
            meta["dims"] = dims
        if name in key:
            meta["primary_key"] = key.index(name)
        nullable = name not in key and logical != "seqnumber"
        fields.append(T.StructField(name, _spark_type(logical), nullable, meta))
    return T.StructType(fields)


def primary_key(schema: T.StructType) -> list[str]:
    """Key columns of a declared schema, in key order."""
    keyed = [f for f in schema.fields if "primary_key" in (f.metadata or {})]
    return [f.name for f in sorted(keyed, key=lambda f: f.metadata["primary_key"])]


def create_table(
    spark: SparkSession,
    table: str,
    columns: dict[str, str] | str,
    primary_key: list[str] | None = None,
    dims: int = 2560,
) -> T.StructType:
    """Declare a table and create it, empty, in the catalog; an existing one is an error."""
    schema = declare_schema(table, columns, primary_key, dims)
    spark.createDataFrame([], schema).write.format("parquet").mode("error").saveAsTable(f"`{table.strip()}`")
    return schema


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in the columns and types of a declared schema; missing columns are NULL."""
    given = set(df.columns)
    columns = [
        (F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name, metadata=f.metadata)
        for f in schema.fields
    ]
    return df.select(*columns)


def schema_frame(spark: SparkSession, schemas: dict[str, T.StructType]) -> DataFrame:
    """Columns of several schemas as rows: ``table, pos, column, type``."""
    rows = [
        (table, pos, field.name, field.dataType.simpleString())
        for table, schema in schemas.items()
        for pos, field in enumerate(schema.fields)
    ]
    return spark.createDataFrame(rows, "table string, pos int, column string, type string")


def preflight(
    spark: SparkSession,
    required: dict[str, T.StructType],
    present: dict[str, T.StructType],
) -> DataFrame:
    """Problems to solve before an ingest: one row per missing table or column, or wrong type."""
    need, have = schema_frame(spark, required), schema_frame(spark, present)
    tables = [(name, name in present) for name in required]
    known = spark.createDataFrame(tables, "table string, table_present boolean")
    have = have.select("table", "column", have["type"].alias("found_type"))
    return (
        need.join(known, "table")
        .join(have, ["table", "column"], "left")
        .selectExpr(
            "table",
            "column",
            "type AS required_type",
            "CASE WHEN NOT table_present THEN 'missing table' WHEN found_type IS NULL THEN 'missing column' "
            "WHEN found_type <> type THEN concat('type is ', found_type) END AS problem",
        )
        .where("problem IS NOT NULL")
    )


def column_checks(df: DataFrame, required: T.StructType) -> DataFrame:
    """What a table's rows are worth for a required schema: ``column, required_type, problem, rows, nulls, failed``.

    One pass counts, per required column, the nulls and the values that cannot be cast to the
    required type. A missing column has only nulls.
    """
    present = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    checks = []
    for field in required.fields:
        kind = field.dataType.simpleString()
        found = present.get(field.name)
        own = F.col(f"`{field.name}`") if found else F.lit(None).cast(kind)
        problem = "missing column" if not found else f"type is {found}" if found != kind else None
        checks.append(F.struct(
            F.lit(field.name).alias("column"), F.lit(kind).alias("required_type"), F.lit(problem).cast("string").alias("problem"),
            F.count(F.lit(1)).alias("rows"), F.count_if(own.isNull()).alias("nulls"),
            F.count_if(own.isNotNull() & own.try_cast(kind).isNull()).alias("failed"),
        ))
    return df.agg(F.array(*checks).alias("c")).select(F.inline("c"))


def catalog_schemas(spark: SparkSession, tables: list[str]) -> dict[str, T.StructType]:
    """Schemas of those tables that exist in the catalog."""
    return {t: spark.table(t).schema for t in tables if spark.catalog.tableExists(t)}
