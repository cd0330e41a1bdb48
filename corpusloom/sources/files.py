"""File sources: listing, scanning, page extraction and fingerprints."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusloom.functions.text import file_name
from corpusloom.session import bounded_batches

# A page is its text, or a function that gives the text and may fail for that page only.
Page = str | Callable[[], str]
Extractor = Callable[[bytes], Iterable[Page]]

NO_TEXT = "no extractable text"

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _glob(ext: str) -> str:
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext.lstrip("."))


def locate(spark: SparkSession, path: str) -> tuple[str, bool]:
    """Full form of a path and whether it names one file; raises if it does not exist."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(target).toString(), system.getFileStatus(target).isFile()


def empty_files(spark: SparkSession, path: str, ext: str | None = None, recursive: bool = False) -> DataFrame:
    """Files without a byte, which Spark's file sources leave out, in the form of a scan.

    The folder is listed on the driver, as for any file scan; only empty files are kept.
    Names below the folder that begin with a dot or an underscore are hidden, as in a scan.
    """
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full, single = locate(spark, path)
    listing = system.listFiles(target, recursive)
    found = []
    while listing.hasNext():
        status = listing.next()
        if status.getLen() == 0:
            name = status.getPath().toString()
            below = name[len(full.rstrip("/")) + 1 :].split("/")
            if not single and any(part.startswith((".", "_")) for part in below):
                continue
            if single or ext is None or name.lower().endswith("." + ext.lower().lstrip(".")):
                found.append((name, status.getModificationTime()))
    rows = spark.createDataFrame(found, "path string, millis bigint")
    return rows.select(
        "path", F.timestamp_millis("millis").alias("modificationTime"), F.lit(0).cast("bigint").alias("length"),
        F.lit(b"").alias("content"),
    )


def scan_files(
    spark: SparkSession, path: str, ext: str = "pdf", recursive: bool = False, with_empty: bool = True
) -> DataFrame:
    """Contents of one file, or of the files of a folder that have an extension in any case.

    Files without a byte are added by a listing on the driver; ``with_empty=False`` spares
    it where there are too many files.
    """
    reader = spark.read.format("binaryFile")
    if not locate(spark, path)[1]:
        reader = reader.option("pathGlobFilter", _glob(ext)).option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(path)
    return found.unionByName(empty_files(spark, path, ext, recursive)) if with_empty else found


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Contents of files that are named one by one; characters of patterns stand for themselves."""
    return spark.read.format("binaryFile").load([re.sub(r"([][{}*?\\])", r"\\\1", path) for path in paths])


def list_files(spark: SparkSession, root: str, depth: int | None = 1, pattern: str | None = None) -> DataFrame:
    """Files below a folder without their contents: ``path, name, depth, length, modified``.

    ``depth`` 0 gives files only if ``root`` is a file, 1 its direct children, None all
    levels. ``pattern`` is a regular expression on the path.
    """
    full, single = locate(spark, root)
    relative = F.substring("path", len(full.rstrip("/")) + 2, 1 << 30)
    level = F.lit(0) if single else F.size(F.split(relative, "/"))
    below = depth is None or depth > 1
    columns = ["path", "modificationTime", "length"]
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", str(below).lower()).load(root)
    every = scan.select(*columns).unionByName(empty_files(spark, root, None, below).select(*columns))
    listed = every.select(
        "path",
        file_name(F.col("path")).alias("name"),
        level.alias("depth"),
        "length",
        F.col("modificationTime").alias("modified"),
    )
    if depth is not None:
        listed = listed.where(F.col("depth") <= depth)
    return listed if pattern is None else listed.where(F.col("path").rlike(pattern))


def skipped_files(spark: SparkSession, path: str, ext: str = "pdf") -> DataFrame:
    """Files of a folder that ``scan_files`` leaves out."""
    return list_files(spark, path, depth=1).where(~F.lower("name").endswith("." + ext.lower().lstrip(".")))


def name_columns(name: str, *ties: str) -> list[Column]:
    """Sort columns of the case-folded name order; the name itself, then ``ties``, decide equal ones."""
    return [F.lower(name), F.col(name), *map(F.col, ties)]


def by_name(df: DataFrame, name: str, *ties: str) -> DataFrame:
    """Rows in case-folded name order."""
    return df.orderBy(*name_columns(name, *ties))


def fingerprint(size: Column, mtime: Column, content: Column) -> Column:
    """Struct ``file_size, mtime, sha256``; ``mtime`` in seconds."""
    seconds = mtime if mtime is None else mtime.cast("double")
    return F.struct(
        size.cast("bigint").alias("file_size"), seconds.alias("mtime"), F.sha2(content, 256).alias("sha256")
    )


def read_documents(files: DataFrame) -> DataFrame:
    """Adds ``filename`` and ``fingerprint`` to scanned files; the digest is computed in the JVM."""
    return files.select(
        F.col("path").alias("source_path"),
        file_name(F.col("path")).alias("filename"),
        fingerprint(F.col("length"), F.col("modificationTime"), F.col("content")).alias("fingerprint"),
        "content",
    )


def _page_texts(content: bytes, extractor: Extractor) -> tuple[list[str], list[str], str | None]:
    pages: list[str] = []
    warnings: list[str] = []
    try:
        for number, page in enumerate(extractor(content), start=1):
            try:
                pages.append((page if isinstance(page, str) else page()) or "")
            except Exception as failure:  # one bad page must not lose the file
                warnings.append(f"page {number} extract failed: {failure}")
                pages.append("")
    except Exception as failure:
        return [], warnings, f"{type(failure).__name__}: {failure}"
    return pages, warnings, None if any(pages) else NO_TEXT


def extract_pages(files: DataFrame, extractor: Extractor, content: str = "content") -> DataFrame:
    """Page texts of files: replaces the content by ``pages``, ``warnings`` and ``error``.

    A file that fails as a whole, or has no text, keeps its row with an error.
    """
    kept = [f for f in files.schema.fields if f.name != content]
    out = T.StructType(
        kept
        + [
            T.StructField("pages", T.ArrayType(T.StringType())),
            T.StructField("warnings", T.ArrayType(T.StringType())),
            T.StructField("error", T.StringType()),
        ]
    )

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = [_page_texts(bytes(data), extractor) for data in batch.pop(content)]
            batch["pages"] = [r[0] for r in results]
            batch["warnings"] = [r[1] for r in results]
            batch["error"] = [r[2] for r in results]
            yield batch

    bounded_batches(files.sparkSession)
    return files.mapInPandas(extract, out)
