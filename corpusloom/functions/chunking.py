"""Documents and pages to chunks, without collecting a document anywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import char_windows, strip_ws

# Rows of one key that are summed in one window; longer keys are split into blocks.
BLOCK = 4096


def chunk_pages(
    df: DataFrame,
    pages: str = "pages",
    windows: Callable[[Column], Column] = char_windows,
) -> DataFrame:
    """Chunks of documents that hold their pages in one array column.

    Adds ``chunk_index`` (0-based over all pages, empty pieces take no number),
    ``page`` (1-based) and ``content``; needs no shuffle.
    """
    stripped = F.transform(F.coalesce(F.col(pages), F.array().cast("array<string>")), lambda p: F.coalesce(strip_ws(p), F.lit("")))
    pieces = F.transform(
        stripped,
        lambda p, i: F.transform(
            F.filter(F.transform(windows(p), strip_ws), lambda c: c != ""),
            lambda c: F.struct((i + 1).cast("int").alias("page"), c.alias("content")),
        ),
    )
    kept = [c for c in df.columns if c != pages]
    return df.select(*kept, F.posexplode(F.flatten(pieces)).alias("chunk_index", "chunk")).select(
        *kept, "chunk_index", F.col("chunk.page").alias("page"), F.col("chunk.content").alias("content")
    )


def chunk_texts(
    df: DataFrame,
    text: str = "text",
    windows: Callable[[Column], Column] = char_windows,
) -> DataFrame:
    """Chunks of one-page documents; narrow, and the stripped text is computed once per row."""
    kept = [c for c in df.columns if c != text]
    stripped = df.select(*kept, strip_ws(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    pieces = F.filter(F.transform(windows(F.col("_text")), strip_ws), lambda c: c != "")
    return stripped.select(*kept, F.posexplode(pieces).alias("chunk_index", "content")).select(
        *kept, "chunk_index", F.lit(1).alias("page"), "content"
    )


def running_total(df: DataFrame, keys: list[str], pos: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same key, in ``pos`` order.

    ``pos`` is a non-negative integer, unique within the key; no keys means one total. A key is cut into
    blocks of positions: sums inside a block and sums of whole blocks are separate
    windows, so a key that holds a third of all rows does not end up in one task.
    """
    blocked = df.withColumn("_block", F.floor(F.col(pos) / block))
    before = lambda order: F.coalesce(
        F.sum("_v").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ).cast("bigint")
    inside = blocked.withColumn("_v", F.col(value)).withColumn(
        "_inside", before(Window.partitionBy(*keys, "_block").orderBy(pos))
    )
    offsets = (
        blocked.groupBy(*keys, "_block")
        .agg(F.sum(value).alias("_v"))
        .select(*keys, "_block", before(Window.partitionBy(*keys).orderBy("_block")).alias("_offset"))
    )
    return inside.join(offsets, [*keys, "_block"]).select(
        *df.columns, (F.col("_inside") + F.col("_offset")).alias(out)
    )


def chunk_page_rows(
    df: DataFrame,
    doc: str,
    page: str,
    text: str,
    windows: Callable[[Column], Column] = char_windows,
) -> DataFrame:
    """Chunks of documents whose pages are rows (``page`` 1-based, unique in a document).

    Gives ``doc, chunk_index, page, content``. Texts are shuffled once, by document
    and block of pages; the block offsets are joined on that same partitioning.
    """
    pieces = F.filter(F.transform(windows(F.col("_text")), strip_ws), lambda c: c != "")
    split = (
        df.select(doc, page, strip_ws(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
        .select(doc, page, pieces.alias("_pieces"))
        .withColumn("_n", F.size("_pieces"))
    )
    counted = running_total(split, [doc], page, "_n", "_before")
    return counted.select(
        doc, page, "_before", F.posexplode("_pieces").alias("_at", "content")
    ).select(
        doc, (F.col("_before") + F.col("_at")).alias("chunk_index"), F.col(page).cast("int").alias("page"), "content"
    )
