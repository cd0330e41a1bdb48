"""Many queries against a stored table: fragments of rows, waves of queries, one product per slice and block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusloom.session import work_folder

# Queries that are compared at a time with a slice of rows; their scores are one matrix.
QUERY_BLOCK = 1_024
SLICE_ROWS = 2_048
# Bytes of stored rows in a fragment, and of queries (with their best rows) that a task holds at a time.
FRAGMENT_BYTES = 8 << 20
WAVE_BYTES = 32 << 20
# More partitions than this many per core are read by one task after the other, so that it keeps one set of best rows.
TASKS_PER_CORE = 4

SCORED = "query_id bigint, row_id bigint, score double"
_NO_ROW = np.iinfo(np.int64).max


def matrix(column: pa.Array | pa.ChunkedArray, dtype: str) -> np.ndarray:
    """Vectors of one size as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"different vector dimensions {sizes.min()} and {sizes.max()}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype, copy=False)


class CodeScore:
    """Differing bits of code words."""

    dtype, margin = "int64", 0.0

    def __init__(self, queries: np.ndarray):
        self.queries = queries

    def all(self, rows: np.ndarray, block: slice) -> np.ndarray:
        total = np.zeros((len(rows), len(self.queries[block])), np.int32)
        for word in range(rows.shape[1]):
            # counted on unsigned words: for a negative number numpy counts the bits of its absolute value
            total += np.bitwise_count((rows[:, word, None] ^ self.queries[None, block, word]).view(np.uint64))
        return total.astype(np.float64)

    def pairs(self, rows: np.ndarray, at: np.ndarray, query: np.ndarray, found: np.ndarray) -> np.ndarray:
        return found


class CosineScore:
    """Cosine distance in double precision; infinite, and given back as NaN, for a zero vector."""

    # the product of two matrices may differ from the sum of one pair by far less than this
    dtype, margin = "float64", 1e-9

    def __init__(self, queries: np.ndarray):
        self.queries = queries
        self.squares = np.einsum("ij,ij->i", queries, queries)

    def all(self, rows: np.ndarray, block: slice) -> np.ndarray:
        norms = np.sqrt(np.einsum("ij,ij->i", rows, rows)[:, None] * self.squares[None, block])
        return self._distance(rows @ self.queries[block].T, norms)

    def pairs(self, rows: np.ndarray, at: np.ndarray, query: np.ndarray, found: np.ndarray | None = None) -> np.ndarray:
        """Equal vectors get equal distances wherever they lie in a slice."""
        a, b = rows[at], self.queries[query]
        return self._distance(np.einsum("ij,ij->i", a, b), np.sqrt(np.einsum("ij,ij->i", a, a) * self.squares[query]))

    @staticmethod
    def _distance(dot: np.ndarray, norms: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1.0 - np.clip(np.where(norms == 0.0, -np.inf, dot / norms), -1.0, 1.0) + np.where(norms == 0.0, np.inf, 0.0)


SCORES = {"code": CodeScore, "cosine": CosineScore}


class Best:
    """The best ``k`` rows of every query of a wave, over all rows that a task has seen; ties by row id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, kind: str, k: int):
        self.ids, self.k = ids, k
        self.score = SCORES[kind](queries.astype(SCORES[kind].dtype, copy=False))
        self.width = queries.shape[1] if len(queries) else None
        self.scores = np.full((len(ids), k), np.inf)
        self.rows = np.full((len(ids), k), _NO_ROW)

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        if len(rows) and self.width is not None and rows.shape[1] != self.width:
            raise ValueError(f"different vector dimensions {rows.shape[1]} and {self.width}")
        for start in range(0, len(rows), SLICE_ROWS):
            part = rows[start : start + SLICE_ROWS].astype(self.score.dtype, copy=False)
            for first in range(0, len(self.ids), QUERY_BLOCK):
                self._add(keys[start : start + SLICE_ROWS], part, slice(first, first + QUERY_BLOCK), first)

    def _add(self, keys: np.ndarray, rows: np.ndarray, block: slice, first: int) -> None:
        found = self.score.all(rows, block)
        limit = self.scores[block, -1]
        near = found <= limit + self.score.margin
        if near.sum() > 4 * self.k * found.shape[1] and len(rows) > self.k:
            limit = np.minimum(limit, np.partition(found, self.k - 1, axis=0)[self.k - 1])
            near = found <= limit + self.score.margin
        at, query = np.nonzero(near)
        if not len(at):
            return
        scores = self.score.pairs(rows, at, query + first, found[at, query])
        touched = np.unique(query) + first
        whose = np.concatenate([np.repeat(touched, self.k), query + first])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        ids = np.concatenate([self.rows[touched].ravel(), keys[at]])
        order = np.lexsort((ids, scores, whose))
        starts = np.searchsorted(whose[order], touched)
        kept = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.scores[touched] = scores[kept].reshape(-1, self.k)
        self.rows[touched] = ids[kept].reshape(-1, self.k)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(self.ids), QUERY_BLOCK):
            rows = self.rows[start : start + QUERY_BLOCK]
            real = rows != _NO_ROW
            scores = self.scores[start : start + QUERY_BLOCK][real]
            ids = np.repeat(self.ids[start : start + QUERY_BLOCK], real.sum(axis=1))
            yield scored(ids, rows[real], scores)


def scored(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    scores = np.where(np.isinf(scores), np.nan, scores)
    arrays = [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(scores, pa.float64())]
    return pa.RecordBatch.from_arrays(arrays, names=["query_id", "row_id", "score"])


def fragments(rows: DataFrame, kind: str) -> DataFrame:
    """``row_id, v`` packed into rows of a few megabytes: ``n, keys, vectors``, cut by their bytes within each task."""
    dtype = "float32" if rows.schema["v"].dataType.elementType.simpleString() == "float" else SCORES[kind].dtype
    schema = pa.schema([("n", pa.int32()), ("dtype", pa.string()), ("keys", pa.binary()), ("vectors", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, width = [], 0, None

        def emit() -> pa.RecordBatch:
            keys, values = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip([len(keys), dtype, keys.tobytes(), values.tobytes()], schema)], schema=schema
            )

        for batch in batches:
            keys, values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), matrix(batch.column(1), dtype)
            if len(values) and width not in (None, values.shape[1]):
                raise ValueError(f"different vector dimensions {width} and {values.shape[1]}")
            width = values.shape[1] if len(values) else width
            step = max(1, FRAGMENT_BYTES // max(1, values.itemsize * values.shape[1]))
            for at in range(0, len(keys), step):
                held.append((keys[at : at + step], values[at : at + step]))
                size += held[-1][1].nbytes
                if size >= FRAGMENT_BYTES:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    return rows.where("v is not null").select("row_id", "v").mapInArrow(pack, "n int, dtype string, keys binary, vectors binary")


class Waves:
    """Queries in waves of bounded size.

    Up to ``limit`` queries (a bounded read shows it) are one wave and are not written.
    More are counted and written once, dealt out by a hash of their ids; a wave is
    then read when its turn comes.
    """

    def __init__(self, queries: DataFrame, limit: int, best: int):
        self.queries = queries
        few = queries.limit(limit + 1).toArrow()
        self.count, self.only = 1, few
        if few.num_rows > limit:
            width = max((len(v) for v in few.column("v").to_pylist()), default=1)
            each = 8 * width + 32 * best
            self.count = max(1, -(-queries.count() * each // WAVE_BYTES))
            self.path = work_folder(queries.sparkSession, "waves")
            wave = F.pmod(F.xxhash64("query_id"), F.lit(self.count)).cast("int")
            queries.withColumn("wave", wave).write.partitionBy("wave").parquet(self.path)
            self.only = None

    def __iter__(self) -> Iterator[pa.Table]:
        if self.only is not None:
            yield self.only
            return
        spark = self.queries.sparkSession
        schema = StructType([*self.queries.schema.fields, StructField("wave", IntegerType())])
        written = spark.read.schema(schema).parquet(self.path)
        for number in range(self.count):
            yield written.where(F.col("wave") == number).drop("wave").toArrow()


def scan_rows(rows: DataFrame, wave: pa.Table, column: str, kind: str, k: int) -> DataFrame:
    """Best ``k`` rows per query and task, from ``row_id, v`` as they are; nothing is shuffled."""
    asked = rows.sparkSession.sparkContext.broadcast(_asked(wave, column, kind))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*asked.value, kind, k)
        for batch in batches:
            best.add(batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1), SCORES[kind].dtype))
        yield from best.batches()

    return rows.where("v is not null").select("row_id", "v").mapInArrow(scan, SCORED)


def scan_fragments(stored: DataFrame, wave: pa.Table, column: str, kind: str, k: int) -> DataFrame:
    """The same from written fragments; a task reads several partitions into one set of best rows."""
    context = stored.sparkSession.sparkContext
    asked = context.broadcast(_asked(wave, column, kind))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*asked.value, kind, k)
        for batch in batches:
            for n, dtype, keys, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                best.add(np.frombuffer(keys, np.int64), np.frombuffer(vectors, dtype).reshape(n, -1))
        yield from best.batches()

    return stored.coalesce(TASKS_PER_CORE * context.defaultParallelism).mapInArrow(scan, SCORED)


def score_pairs(rows: DataFrame, wave: pa.Table, column: str, pairs: pa.Table) -> DataFrame:
    """Exact cosine distance of given pairs (``query_id, row_id``) of a wave: ``query_id, row_id, score``.

    The pairs go to the rows, where a row is found by its id; no vector is shuffled.
    """
    ids, vectors = _asked(wave, column, "cosine")
    order = np.argsort(ids, kind="stable")
    query = order[np.searchsorted(ids[order], pairs.column("query_id").to_numpy())] if len(ids) else np.zeros(0, np.int64)
    wanted = pairs.column("row_id").to_numpy()
    by_row = np.argsort(wanted, kind="stable")
    sent = rows.sparkSession.sparkContext.broadcast((ids, vectors, wanted[by_row], query[by_row]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, wanted, query = sent.value
        cosine = CosineScore(vectors)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            first, last = np.searchsorted(wanted, keys), np.searchsorted(wanted, keys, "right")
            hit = np.flatnonzero(last > first)
            if not len(hit):
                continue
            values = matrix(batch.column(1).take(pa.array(hit)), "float64")
            if values.shape[1] != vectors.shape[1]:
                raise ValueError(f"different vector dimensions {values.shape[1]} and {vectors.shape[1]}")
            counts = (last - first)[hit]
            at = np.repeat(np.arange(len(hit)), counts)
            place = np.concatenate([np.arange(a, b) for a, b in zip(first[hit], last[hit])])
            yield scored(ids[query[place]], keys[hit][at], cosine.pairs(values, at, query[place]))

    return rows.where("v is not null").select("row_id", "v").mapInArrow(score, SCORED)


def _asked(wave: pa.Table, column: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    ids = wave.column("query_id").to_numpy().astype(np.int64)
    return ids, matrix(wave.column(column), SCORES[kind].dtype)
