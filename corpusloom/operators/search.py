"""Nearest-neighbour search: sign-code candidates, exact cosine rerank."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.vectors import (
    code_words, cosine_distance, hamming, query_words, require_dims, vector_literal_column,
)
from corpusloom.operators.keys import stored_table
from corpusloom.operators.query_waves import QUERY_BLOCK, Waves, fragments, scan_fragments, scan_rows, score_pairs
from corpusloom.session import materialise

# A query's candidates from more tasks than this are merged in groups of tasks first.
MERGED_TASKS = 512
# The first rows of stored codes that a search reads differ from the query's number of set bits by so much, or dims / 32.
FIRST_RADIUS = 4
# Candidate ids that are put into a scan as a list; more are joined.
LISTED_IDS = 10_000


def candidate_count(k: int | None, rerank_factor: int | None) -> tuple[int, int]:
    """(rows wanted, candidates); a missing or non-positive argument counts as 1."""
    k = max(k or 1, 1)
    return k, k * max(rerank_factor or 1, 1)


def code_columns(df: DataFrame) -> list[str]:
    """Code word columns of a code table, in word order."""
    found = [c for c in df.columns if c.startswith("w") and c[1:].isdigit()]
    return sorted(found, key=lambda c: int(c[1:]))


def build_codes(df: DataFrame, key: str, vec_col: str, dims: int) -> DataFrame:
    """The code table of a vector column: ``key`` and one bigint per 64 dimensions.

    It stands in for a vector index: a search reads 1/32 of the vector data. Rows
    without a vector have no code.
    """
    missing = [c for c in (key, vec_col) if c not in df.columns]
    if missing:
        raise ValueError(f'Column "{missing[0]}" does not exist')
    known = df.where(F.col(vec_col).isNotNull()).select(key, require_dims(F.col(vec_col), dims).alias("_v"))
    return known.select(key, *[w.alias(f"w{i}") for i, w in enumerate(code_words(F.col("_v"), dims))])


def set_bits(words: list[Column]) -> Column:
    """Number of set bits of a code."""
    total = F.bit_count(words[0])
    for word in words[1:]:
        total = total + F.bit_count(word)
    return total


def store_codes(df: DataFrame, key: str, vec_col: str, dims: int, path: str) -> DataFrame:
    """Bring the code table at ``path`` up to date with ``df`` and read it.

    Codes lie in a folder per number of set bits, by which a search leaves folders out. Keys
    without a code get theirs appended, codes of keys that are gone are left
    out, so a grown or cut table is searched as it is. A write that died left nothing
    that is read. A vector that changes must get a new key.
    """
    stored = stored_table(df.sparkSession, path)
    missing = df if stored is None else df.join(stored.select(key), key, "left_anti")
    codes = build_codes(missing, key, vec_col, dims)
    codes = codes.withColumn("bits", set_bits([F.col(c) for c in code_columns(codes)]))
    codes.repartitionByRange("bits", key).write.mode("append").partitionBy("bits").parquet(path)
    present = df.where(F.col(vec_col).isNotNull()).select(key)
    schema = codes.select(key, *code_columns(codes), "bits").schema
    return df.sparkSession.read.schema(schema).parquet(path).join(present, key, "left_semi")


def nearest_codes(codes: DataFrame, key: str, query: list[float], wanted: int) -> tuple[list, list[int]]:
    """Keys of the ``wanted`` rows with the smallest code distance, equal ones in key order; and the radii that were read.

    Two codes differ in at least as many bits as their numbers of set bits. So only the
    rows whose ``bits`` are near those of the query are read, then those that are as far
    away as the last candidate found, and no row further out can replace one: it is
    the result of the whole table. The keys that come to the driver are bounded by the call.
    """
    target = query_words(query)
    own = sum((word & (1 << 64) - 1).bit_count() for word in target)
    distance = hamming([F.col(c) for c in code_columns(codes)], [F.lit(w).cast("bigint") for w in target])
    best: list[tuple] = []
    radii, seen = [max(FIRST_RADIUS, len(query) // 32)], -1
    while True:
        radius = radii[-1]
        ring = F.col("bits").between(own - radius, own + radius)
        if seen >= 0:
            ring = ring & ~F.col("bits").between(own - seen, own + seen)
        found = codes.where(ring).select(distance.alias("_h"), key).orderBy("_h", key).limit(wanted).collect()
        best = sorted([*best, *(tuple(row) for row in found)])[:wanted]
        full = len(best) == wanted
        if radius >= len(query) or full and best[-1][0] <= radius:
            return [row[1] for row in best], radii
        seen = radius
        radii.append(best[-1][0] if full else len(query) if len(radii) > 1 else 4 * radius)


def find_closest(
    df: DataFrame,
    key: str,
    vec_col: str,
    query: list[float],
    k: int | None = 5,
    rerank_factor: int | None = 4,
    codes: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` rows closest to a query vector, without the vector, plus ``distance``.

    Candidates are the rows with the smallest code distance, equal ones in key order;
    of stored codes only the folders near the query's number of set bits are read.
    Their keys (``k`` times the factor, so bounded by the call) are fetched first and
    become a pushed-down filter of the second scan: wide columns and raw vectors are
    read only for row groups that hold a candidate.
    """
    if vec_col not in df.columns:
        raise ValueError(f'Column "{vec_col}" does not exist')
    k, wanted = candidate_count(k, rerank_factor)
    if codes is None:
        codes = build_codes(df.select(key, vec_col), key, vec_col, len(query))
    words = [F.col(c) for c in code_columns(codes)]
    target = [F.lit(w).cast("bigint") for w in query_words(query)]
    if len(words) != len(target):
        raise ValueError(f"query has {len(query)} dims, the codes have {len(words)} words")
    nearest = codes.select(key, hamming(words, target).alias("_h")).orderBy("_h", key).limit(wanted).select(key)
    if wanted > LISTED_IDS:
        rows = df.join(nearest, key, "left_semi")
    elif "bits" in codes.columns:
        rows = df.where(F.col(key).isin(nearest_codes(codes, key, query, wanted)[0]))
    else:
        rows = df.where(F.col(key).isin([row[key] for row in nearest.collect()]))
    distance = cosine_distance(F.col(vec_col), vector_literal_column(query))
    return rows.withColumn("distance", distance).drop(vec_col).orderBy("distance", key).limit(k)


def top_k_per_query(df: DataFrame, query_key: str, order: list[str | Column], k: int, rank: str = "rank") -> DataFrame:
    """The ``k`` first rows of every query with their 1-based rank."""
    window = Window.partitionBy(query_key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """``query_id, row_id, score, rank`` of the best ``k`` rows per query, from those of every task."""
    if parts.rdd.getNumPartitions() > MERGED_TASKS:
        group = F.pmod(F.spark_partition_id(), F.lit(MERGED_TASKS // 8))
        best = Window.partitionBy("query_id", "_group").orderBy("score", "row_id")
        ranked = parts.withColumn("_group", group).withColumn("_rank", F.row_number().over(best))
        parts = ranked.where(F.col("_rank") <= k).drop("_group", "_rank")
    return top_k_per_query(parts, "query_id", ["score", "row_id"], k)


class _Stored:
    """Stored rows ``row_id, v``: read as they are for one wave of queries, packed into fragments once for more."""

    def __init__(self, rows: DataFrame, kind: str, waves: Waves):
        self.rows, self.kind = rows, kind
        self.packed = None if waves.only is not None else materialise(fragments(rows, kind), "fragments")

    def best(self, wave: pa.Table, column: str, k: int) -> DataFrame:
        if self.packed is None:
            return _merged(scan_rows(self.rows, wave, column, self.kind, k), k)
        return _merged(scan_fragments(self.packed, wave, column, self.kind, k), k)


def _wave_result(found: DataFrame, waves: Waves) -> DataFrame:
    """The result of a wave; of several each is written before the next one's queries are read."""
    return found if waves.only is not None else materialise(found, "wave")


def _together(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, found)


def _code_array(df: DataFrame) -> Column:
    return F.array(*[F.col(c) for c in code_columns(df)])


def exact_knn(
    df: DataFrame,
    key: str,
    vec_col: str,
    queries: DataFrame,
    query_key: str,
    query_vec: str,
    k: int = 5,
    query_limit: int = QUERY_BLOCK,
) -> DataFrame:
    """Exact cosine top-k of many queries: ``query_id, row_id, distance, rank``.

    Up to ``query_limit`` queries go to the tasks that read the rows. More go there in
    waves of bounded size, and the rows are packed once into fragments for all waves.
    Neither rows nor queries are ever shuffled, only the best rows of each task are.
    """
    rows = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(vec_col).alias("v"))
    asked = queries.select(F.col(query_key).cast("bigint").alias("query_id"), F.col(query_vec).alias("v")).where("v is not null")
    k = max(k, 1)
    waves = Waves(asked, query_limit, k)
    stored = _Stored(rows, "cosine", waves)
    found = [_wave_result(stored.best(wave, "v", k), waves) for wave in waves]
    return _together(found).withColumnRenamed("score", "distance")


def find_closest_batch(
    df: DataFrame,
    key: str,
    vec_col: str,
    queries: DataFrame,
    query_key: str,
    query_vec: str,
    dims: int,
    k: int | None = 5,
    rerank_factor: int | None = 4,
    codes: DataFrame | None = None,
    query_limit: int = QUERY_BLOCK,
) -> DataFrame:
    """``find_closest`` for many queries: ``query_id, row_id, distance, rank``.

    Each wave of queries meets the codes, as in ``exact_knn``; the best candidates (at most
    ``k`` times the factor per query) then go to the raw vectors and are scored where
    these are read.
    """
    k, wanted = candidate_count(k, rerank_factor)
    if codes is None:
        codes = build_codes(df.select(key, vec_col), key, vec_col, dims)
    asked = queries.where(F.col(query_vec).isNotNull()).select(
        F.col(query_key).cast("bigint").alias("query_id"), require_dims(F.col(query_vec), dims).alias("v")
    )
    asked = asked.select("query_id", "v", F.array(*code_words(F.col("v"), dims)).alias("code"))
    rows = codes.select(F.col(key).cast("bigint").alias("row_id"), _code_array(codes).alias("v"))
    vectors = df.select(F.col(key).cast("bigint").alias("row_id"), F.col(vec_col).alias("v"))
    waves = Waves(asked, query_limit, wanted)
    stored = _Stored(rows, "code", waves)
    found = []
    for wave in waves:
        pairs = stored.best(wave, "code", wanted).select("query_id", "row_id").toArrow()
        scored = score_pairs(vectors, wave, "v", pairs)
        found.append(_wave_result(top_k_per_query(scored, "query_id", ["score", "row_id"], k), waves))
    return _together(found).withColumnRenamed("score", "distance")


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found: ``query_id, hits, wanted, recall``."""
    hit = found.select("query_id", "row_id", F.lit(1).alias("_hit"))
    return (
        exact.select("query_id", "row_id")
        .join(hit, ["query_id", "row_id"], "left")
        .groupBy("query_id")
        .agg(F.count("_hit").alias("hits"), F.count(F.lit(1)).alias("wanted"))
        .withColumn("recall", F.col("hits") / F.col("wanted"))
    )
