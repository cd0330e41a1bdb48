"""Pieces shared by the operators: columns, Arrow batches, files in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.session import bounded_batches, ship_package

Batches = Iterator[pa.RecordBatch]
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text column; a null text is empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def remainder_of_id(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def rows_to_batches(
    batches: Batches, schema: pa.Schema, rows_of: Callable[[pa.RecordBatch], Iterator[tuple]], limit: int = 8 << 20
) -> Batches:
    """Collect the tuples made from each batch into output batches of bounded size.

    A batch ends after 4,096 rows or about ``limit`` bytes of texts and binaries.
    """
    rows: list[tuple] = []
    held = 0

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema
        )

    for batch in batches:
        for row in rows_of(batch):
            rows.append(row)
            held += sum(len(value) for value in row if isinstance(value, (str, bytes)))
            if len(rows) >= 4096 or held >= limit:
                yield emit()
                rows, held = [], 0
    if rows:
        yield emit()


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a folder or file that all executors share."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# What a worker keeps between tasks: one thing at a time, so that the caches of different operators do not add up
_held: dict = {}


def hold(key: tuple, make: Callable[[], object]):
    """The worker's value for ``key``, made once; whatever it held for another key is dropped."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drop what the worker holds, and give back what Arrow keeps of earlier tasks' memory."""
    _held.clear()
    pa.default_memory_pool().release_unused()


def prepare(spark: SparkSession) -> None:
    """Before a job with Python tasks: ship the package, and keep Arrow batches small where nobody has set their size."""
    ship_package(spark)
    bounded_batches(spark, ARROW_BYTES)


def new_file(folder: str, suffix: str) -> tuple[str, pa.NativeFile]:
    """A file of a fresh name below ``folder``, open for writing.

    Attempts of one task never share a name. A file counts only if the manifest,
    which Spark commits, lists it; those of lost attempts are never read.
    """
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder.rstrip('/')}/{name}", store.open_output_stream(f"{path}/{name}", compression=None)
