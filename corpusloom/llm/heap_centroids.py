"""Exact centroid clustering: each cluster keeps a heap of bound gaps, only expired vectors are compared again."""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.llm.common import Batches, prepare
from corpusloom.session import materialise, work_folder

BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 128 << 20
# so that a squared distance and the sums of products fit a long
LARGEST = 1 << 27
# bounds are widened by this share, far above the rounding error of the sums that make them
SLACK = 1e-12

_BLOCKS = "block bigint, ids binary, vectors binary, n int, least bigint, greatest bigint"
_STATE = "block bigint, own binary, keys binary, places binary, sizes array<int>, change array<bigint>, scanned bigint"
_STATE_COLUMNS = ["own", "keys", "places", "sizes"]


def grid_vector(vector: str, dims: int, scale: int) -> Column:
    """The vector as whole numbers, floor(scale * x) of each component; null if it takes no part.

    Without a part are vectors that are null, of another number of components, or hold
    a null or a component that is not finite. A component beyond LARGEST is an error.
    """
    real = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists(real, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    floors = F.transform(real, lambda x: F.floor(x * F.lit(float(scale))))
    too_large = F.exists(real, lambda x: F.abs(x * F.lit(float(scale))) > F.lit(float(LARGEST)))
    checked = F.when(too_large, F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}"))).otherwise(floors)
    return F.when(F.col(vector).isNotNull() & (F.size(vector) == dims) & ~bad, checked).cast("array<bigint>")


def _dtype(least: int, greatest: int) -> type:
    """The smallest type of a block's components."""
    return next(t for t in (np.int8, np.int16, np.int32) if np.iinfo(t).min <= least and greatest <= np.iinfo(t).max)


class Model:
    """Centroids of a round with what their last moves did to the bounds; of fixed size, a few numbers per cluster."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        self.dims = len(centroids[0])
        self.largest = max(abs(x) for c in centroids for x in c)
        # per cluster, by how much the gap of its vectors can have closed since the start
        self.closed = [0.0] * len(centroids)
        self.sums = [[0] * self.dims for _ in centroids]
        self.counts = [0] * len(centroids)

    def move(self, change: list[int]) -> None:
        """Take in the changes of sums and counts, then move the centroids to the floors of their means."""
        width = self.dims + 1
        drift = []
        for j, old in enumerate(self.centroids):
            part = change[j * width : (j + 1) * width]
            self.sums[j] = [a + b for a, b in zip(self.sums[j], part)]
            self.counts[j] += part[-1]
            new = [s // self.counts[j] for s in self.sums[j]] if self.counts[j] else old
            drift.append(math.sqrt(sum((a - b) ** 2 for a, b in zip(old, new))))
            self.centroids[j] = new
        self.largest = max(abs(x) for c in self.centroids for x in c)
        # the own centroid can move away, the nearest other one can come closer
        for j, own in enumerate(drift):
            others = max((d for i, d in enumerate(drift) if i != j), default=0.0)
            self.closed[j] = (self.closed[j] + own + others) * (1 + SLACK)

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Exact squared distances of vectors to all centroids."""
        largest = max(int(np.abs(vectors, dtype=np.int64).max(initial=0)), self.largest)
        # products and their sums are exact in double precision up to 2**53
        kind = np.float64 if 4 * largest * largest * self.dims < 1 << 53 else np.int64
        x, c = vectors.astype(kind), np.array(self.centroids, kind)
        found = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
        return found.astype(np.int64)

    def own_distances(self, vectors: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Exact squared distances of vectors to the centroid of their cluster."""
        gap = vectors.astype(np.int64) - np.array(self.centroids, np.int64)[own]
        return (gap * gap).sum(axis=1)


class Heaps:
    """The clusters of a block's vectors, and per cluster a heap of (gap when compared + closed then, place).

    The gap is the lower bound of the distance to any other centroid less the upper bound of
    the distance to the own one. While it is above zero the cluster is the nearest, without
    a tie. Moves close the gaps of a cluster by the same amount, so they are not changed
    one by one: a vector expires when its key is no more than what has closed by now.
    """

    def __init__(self, own: np.ndarray, keys: np.ndarray, places: np.ndarray, sizes: list[int]):
        self.own = own
        ends = np.cumsum(sizes)
        self.heaps: list = [(keys[e - s : e], places[e - s : e]) for s, e in zip(sizes, ends)]

    @classmethod
    def new(cls, n: int, clusters: int) -> Heaps:
        """All vectors expired, in no cluster yet."""
        return cls(np.full(n, -1, np.int32), np.zeros(0), np.zeros(0, np.int32), [0] * clusters)

    def _heap(self, j: int) -> list:
        # only heaps that change leave their arrays; an array in heap order is a heap again
        if isinstance(self.heaps[j], tuple):
            keys, places = self.heaps[j]
            self.heaps[j] = list(zip(keys.tolist(), places.tolist()))
        return self.heaps[j]

    def expired(self, closed: list[float]) -> np.ndarray:
        """Pop every vector whose gap has closed."""
        found = np.flatnonzero(self.own < 0).tolist()
        for j, limit in enumerate(closed):
            heap = self.heaps[j]
            if isinstance(heap, tuple) and (not len(heap[0]) or heap[0][0] > limit):
                continue
            heap = self._heap(j)
            while heap and heap[0][0] <= limit:
                found.append(heapq.heappop(heap)[1])
        return np.array(found, np.int64)

    def rescan(self, model: Model, vectors: np.ndarray) -> tuple[np.ndarray, int]:
        """Pop what has expired and compare it with all centroids; the changes of sums and counts, vectors compared."""
        clusters = len(model.centroids)
        change = np.zeros((clusters, model.dims + 1), np.int64)
        at = self.expired(model.closed)
        if len(at):
            rows = np.arange(len(at))
            distances = model.distances(vectors[at])
            nearest = distances.argmin(axis=1)  # of ties the smallest number
            upper = np.sqrt(distances[rows, nearest].astype(np.float64))
            if clusters > 1:
                distances[rows, nearest] = np.iinfo(np.int64).max
                lower = np.sqrt(distances.min(axis=1).astype(np.float64))
            else:
                lower = np.full(len(at), np.inf)
            keys = (lower - upper) - SLACK * (1 + lower + upper) if clusters > 1 else lower
            keys = keys + np.array(model.closed)[nearest] * (1 - SLACK)
            for key, place, j in zip(keys.tolist(), at.tolist(), nearest.tolist()):
                heapq.heappush(self._heap(j), (key, place))
            old = self.own[at]
            moved = old != nearest
            whole = np.concatenate([vectors[at].astype(np.int64), np.ones((len(at), 1), np.int64)], axis=1)
            np.add.at(change, nearest[moved], whole[moved])
            left = moved & (old >= 0)
            np.subtract.at(change, old[left], whole[left])
            self.own[at] = nearest
        return change, len(at)

    def columns(self) -> tuple[bytes, bytes, bytes, list[int]]:
        """The stored form: clusters, keys and places of all heaps one after the other, their sizes."""
        keys, places = [], []
        for heap in self.heaps:
            if isinstance(heap, list):
                heap = (np.array([k for k, _ in heap], np.float64), np.array([p for _, p in heap], np.int32))
            keys.append(heap[0])
            places.append(heap[1])
        return (
            self.own.tobytes(), np.concatenate(keys).astype(np.float64).tobytes(),
            np.concatenate(places).astype(np.int32).tobytes(), [len(k) for k in keys],
        )


def _vectors(row: dict, dims: int) -> np.ndarray:
    return np.frombuffer(row["vectors"], _dtype(row["least"], row["greatest"])).reshape(-1, dims)


def _rows(batches: Batches):
    for batch in batches:
        yield from (dict(zip(batch.schema.names, (c[i].as_py() for c in batch.columns))) for i in range(batch.num_rows))


def _blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """Blocks of vectors (``id, v``), each of one task's rows; keys keep their type as an Arrow stream."""
    schema = pa.schema([
        ("block", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("n", pa.int32()), ("least", pa.int64()), ("greatest", pa.int64())
    ])
    size = max(1, BLOCK_BYTES // (4 * dims))

    def run(batches: Batches) -> Batches:
        task, made, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def emit() -> pa.RecordBatch:
            ids = pa.concat_arrays([b.column(0) for b in held])
            numbers = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in held])
            least, greatest = int(numbers.min()), int(numbers.max())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as writer:
                writer.write_batch(pa.record_batch([ids], names=["id"]))
            values = [(task << 32) + made, sink.getvalue().to_pybytes(), numbers.astype(_dtype(least, greatest)).tobytes(), len(ids), least, greatest]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema)], schema=schema)

        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, size - rows)
                batch = batch.slice(taken.num_rows)
                held.append(taken)
                rows += taken.num_rows
                if rows == size:
                    yield emit()
                    made, held, rows = made + 1, [], 0
        if rows:
            yield emit()

    return vectors.mapInArrow(run, _BLOCKS)


class Tables:
    """Tables in buckets of ``block``, so that blocks meet their state without a shuffle; their names last for a with."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def __enter__(self) -> Tables:
        return self

    def write(self, df: DataFrame, purpose: str) -> DataFrame:
        self.names.append(f"corpusloom_{uuid.uuid4().hex}")
        path = work_folder(self.spark, purpose)
        written = df.write.format("parquet").bucketBy(self.buckets, "block").sortBy("block")
        written.option("path", path).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay in the shared folder


def _round(blocks: DataFrame, state: DataFrame | None, model: Model) -> DataFrame:
    """The state of every block after the vectors whose gaps closed were compared again."""
    schema = pa.schema([
        ("block", pa.int64()), ("own", pa.binary()), ("keys", pa.binary()), ("places", pa.binary()),
        ("sizes", pa.list_(pa.int32())), ("change", pa.list_(pa.int64())), ("scanned", pa.int64()),
    ])

    def run(batches: Batches) -> Batches:
        for row in _rows(batches):
            vectors = _vectors(row, model.dims)
            if row.get("own") is None:
                heaps = Heaps.new(len(vectors), len(model.centroids))
            else:
                heaps = Heaps(
                    np.frombuffer(row["own"], np.int32).copy(), np.frombuffer(row["keys"], np.float64),
                    np.frombuffer(row["places"], np.int32), row["sizes"],
                )
            change, scanned = heaps.rescan(model, vectors)
            values = [row["block"], *heaps.columns(), change.ravel().tolist(), scanned]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema)], schema=schema)

    rows = blocks.select("block", "vectors", "least", "greatest")
    if state is not None:
        rows = rows.join(state.select("block", *_STATE_COLUMNS), "block")
    return rows.mapInArrow(run, _STATE)


def _changes(state: DataFrame, length: int) -> list[int]:
    """The sum of all blocks' changes, ``length`` numbers; added up in the tasks first."""

    def add(batches: Batches) -> Batches:
        total = np.zeros(length, np.int64)
        for batch in batches:
            numbers = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            total += numbers.sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["at", "value"])

    rows = state.select("change").mapInArrow(add, "at int, value bigint").groupBy("at").agg(F.sum("value").alias("value")).collect()
    found = [0] * length
    for row in rows:
        found[row.at] = row.value
    return found


class Clustering:
    """What ``cluster`` found: the model, the last state and how many vectors each pass compared."""

    def __init__(self, model: Model | None, assigned: DataFrame, scanned: list[int]):
        self.model, self.assigned, self.scanned = model, assigned, scanned


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, clusters: int = 40, rounds: int = 5,
    scale: int = 256, seed: str = "2",
) -> Clustering:
    """Exact rounds of assignment and centroid means over all vectors; ``assigned`` has ``key, cluster, distance``.

    Components are whole numbers, floor(scale * x). The first centroids are the vectors
    with the smallest SHA-256 of "seed:key", in that order; of equal keys the smaller
    vector comes first, null keys come not at all, and fewer vectors give fewer
    centroids. In each round every vector belongs to the nearest centroid (ties: the smaller number), and
    centroids become the floors of their means, empty ones stay. A last
    assignment follows. Vectors lie in blocks; each block's heaps are stored between
    rounds, and in a round only the vectors at the top whose gap has closed are read off
    the heaps and compared again, exactly. Blocks and states are bucketed alike and meet without a shuffle.
    Vectors that are null, of another size, or hold null or non-finite components take
    no part. Repeated rows are clustered each. Without any vector the result is empty.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kept = vectors.select(F.col(key).alias("id"), grid_vector(vector, dims, scale).alias("v")).where("v is not null")
    kept = materialise(kept, "grid-vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = [r.v for r in kept.where("id is not null").orderBy(digest, "v").limit(clusters).select("v").collect()]
    size = kept.count()
    if not first:
        nothing = kept.where(F.lit(False)).select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return Clustering(None, nothing, [])
    model = Model([list(v) for v in first])
    buckets = max(spark.sparkContext.defaultParallelism, -(-size * dims * 4 // BUCKET_BYTES))
    with Tables(spark, buckets) as tables:
        blocks = tables.write(_blocks(kept, dims), "vector-blocks")
        state, scanned = None, []
        for n in range(rounds + 1):
            state = tables.write(_round(blocks, state, model), f"heaps-{n}")
            scanned.append(state.agg(F.sum("scanned")).first()[0])
            if n < rounds:
                model.move(_changes(state, len(first) * (dims + 1)))
        assigned = materialise(_assigned(blocks, state, model, kept.schema["id"].dataType.simpleString(), key), "clustered")
    return Clustering(model, assigned, scanned)


def _assigned(blocks: DataFrame, state: DataFrame, model: Model, id_type: str, key: str) -> DataFrame:
    def run(batches: Batches) -> Batches:
        for row in _rows(batches):
            ids = pa.ipc.open_stream(row["ids"]).read_all().column(0).combine_chunks()
            own = np.frombuffer(row["own"], np.int32)
            distances = model.own_distances(_vectors(row, model.dims), own)
            yield pa.record_batch([ids, pa.array(own), pa.array(distances)], names=["id", "cluster", "distance"])

    rows = blocks.select("block", "ids", "vectors", "least", "greatest").join(state.select("block", "own"), "block")
    return rows.mapInArrow(run, f"id {id_type}, cluster int, distance bigint").withColumnRenamed("id", key)


def clustered(vectors: DataFrame, key: str = "vec_id", **settings) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that takes part."""
    spark = vectors.sparkSession
    found = cluster(vectors, key, **settings)
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    rows = []
    if found.model:
        inertia = dict(found.assigned.groupBy("cluster").agg(F.sum("distance")).collect())
        rows = [
            (j, inertia.get(j, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
            for j, c in enumerate(found.model.centroids)
        ]
    # a row per cluster
    return found.assigned.join(F.broadcast(spark.createDataFrame(rows, schema)), "cluster")
