"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A frame is broadcast by hand only after it was counted (or proven) to hold at
# most this many rows; anything larger is left to shuffle joins and AQE.
BROADCAST_ROWS = 10_000


def session(app: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for.

    Cluster-wide values (memory, executors, checkpoint folder) are left to
    spark-submit; only settings that change results or plan quality are set.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split a hot join key even where that costs one more shuffle
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


# bytes of a batch that goes to a Python worker, where nobody has set them
ARROW_BYTES = 4 << 20
_ARROW_NAME = "spark.sql.execution.arrow.maxBytesPerBatch"
# how Spark gives its own value, with the unit
_ARROW_DEFAULTS = (f"{64 << 20}b", str(64 << 20), "64MB", "64m")


def bounded_batches(spark: SparkSession | None, size: int = ARROW_BYTES) -> None:
    """Before a job with Python functions over texts: a worker holds a batch several times over, as text, objects and result."""
    if spark is not None and spark.conf.get(_ARROW_NAME) in _ARROW_DEFAULTS:
        spark.conf.set(_ARROW_NAME, str(size))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, where it was not installed or passed with --py-files."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom")
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", root, "corpusloom"))
        _shipped.add(app)


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a session whose driver and
    executors are one process may fall back to a temporary folder, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/corpusloom/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result must not be computed twice (model calls, row positions)
    and must survive the loss of executors.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer partitions than cores, dealt out for work that is heavy per row.

    Only small inputs are shuffled: a large table has more partitions than cores and
    is returned as it is. ``scan`` must be a plain read, without a shuffle of its own.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a bounded count shows at most ``limit`` rows."""
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df
