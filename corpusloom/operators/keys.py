"""Sequence numbers, primary keys and appends."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.session import materialise


def assign_seq(df: DataFrame, out: str, order_by: list[str | Column], start: int = 1) -> DataFrame:
    """Dense numbers from ``start`` in the given order, without one global window.

    ``order_by`` should end in a unique column: equal sort values cannot be spread
    over tasks. The rows are range-sorted and written once with their position in
    the partition; the offsets are one number per written partition.
    """
    position = materialise(df.orderBy(*order_by).withColumn("_pos", F.monotonically_increasing_id()), "seq")
    part = F.shiftright("_pos", 33)
    counts = position.groupBy(part.alias("part")).count().orderBy("part").collect()
    offsets, total = [], start
    for row in counts:
        offsets.append((row["part"], total))
        total += row["count"]
    lookup = df.sparkSession.createDataFrame(offsets, "_part bigint, _offset bigint")
    place = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    return position.join(F.broadcast(lookup), part == F.col("_part")).select(
        (F.col("_offset") + place).alias(out), *df.columns
    )


def next_seq(table: DataFrame, col: str) -> int:
    """The number after the largest one in use."""
    top = table.agg(F.max(col).alias("top")).first()["top"]
    return 1 if top is None else int(top) + 1


# A Bloom filter has one 64-bit block for every so many new keys, at most BLOOM_BLOCKS, each sent to all tasks.
BLOOM_KEYS, BLOOM_BLOCKS = 4, 1 << 18
BLOOM_BITS = 6


def _bloom_place(keys: list[str], blocks: int) -> tuple[Column, Column]:
    """Block of a key, and its bits within the block."""
    place = F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")
    bits = F.lit(0).cast("bigint")
    own = F.xxhash64(F.lit(1), *keys)
    for i in range(BLOOM_BITS):
        bit = F.shiftright(own, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return place, bits


def possible_matches(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``stored`` (its ``keys`` only) that may have a key of ``new``: all that have one, and few others.

    A blocked Bloom filter of the new keys is aggregated on the executors. Its blocks, whose number is
    bounded, meet the stored rows where these are read, so the others are dropped before any
    shuffle. Many new keys make it let more rows through, never fewer.
    """
    if any(stored.schema[k].dataType != new.schema[k].dataType for k in keys):
        return stored.select(*keys)  # equal values of two types may have other hashes
    known = new.select(*keys).dropna()
    count = known.count()
    blocks = max(1, min(BLOOM_BLOCKS, -(-count // BLOOM_KEYS)))
    place, bits = _bloom_place(keys, blocks)
    bloom = known.groupBy(place.alias("_place")).agg(F.bit_or(bits).alias("_bits"))
    met = stored.select(*keys).dropna().withColumn("_place", place).join(F.broadcast(bloom), "_place")
    return met.where(F.col("_bits").bitwiseAND(bits) == bits).select(*keys)


def pk_violations(df: DataFrame, keys: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Key values that occur twice, hold a NULL, or are already stored: ``keys, n, problem``.

    Stored keys pass a Bloom filter of the new ones where they are read; only what passes
    is shuffled. They need not be unique.
    """
    null_key = F.lit(False)
    for key in keys:
        null_key = null_key | F.col(key).isNull()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    result = counts.withColumn("problem", F.when(null_key, "null").when(F.col("n") > 1, "duplicate"))
    if existing is not None:
        stored = possible_matches(existing, df, keys)
        fresh = result.where(F.col("problem").isNull())
        exists = fresh.join(stored, keys, "left_semi").withColumn("problem", F.lit("exists"))
        return result.where(F.col("problem").isNotNull()).unionByName(exists)
    return result.where(F.col("problem").isNotNull())


def enforce_pk(df: DataFrame, keys: list[str], existing: DataFrame | None = None) -> DataFrame:
    """``df`` itself, or an error that shows some of the offending keys."""
    bad = pk_violations(df, keys, existing).limit(5).collect()
    if bad:
        raise ValueError(f"primary key ({', '.join(keys)}) violated: {[r.asDict() for r in bad]}")
    return df


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A parquet table, or None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append_rows(
    df: DataFrame,
    path: str,
    seq: str = "id",
    order_by: list[str | Column] | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Append rows to a parquet table and return them as stored, with their new ids.

    One writer at a time: ids continue after the largest stored one. The rows are
    numbered from a written copy, so the returned frame and the table agree.
    """
    spark = df.sparkSession
    current = stored_table(spark, path)
    start = 1 if current is None else next_seq(current, seq)
    numbered = assign_seq(df, seq, order_by or [F.col(c) for c in df.columns], start)
    if keys:
        enforce_pk(numbered, keys, current)
    numbered.write.mode("append").parquet(path)
    return numbered
