"""Exact top-k inner products: ball trees per shard, branch and bound with a shared kth score."""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.common import Batches, prepare
from corpusloom.session import materialise, spread

SHARD_ROWS = 8192
LEAF_ROWS = 64
QUERY_BLOCK = 512
_EXACT = float(1 << 53)


def usable(vector: str) -> Column:
    """The vector is not null and holds neither nulls nor non-finite components."""
    x = F.col(vector)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def _matrix(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, which hold these integers exactly; shorter vectors are filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), max(int(sizes.max(initial=0)), 1)))
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return {name: found[name] for name in found.files}


def build(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """A ball tree: rows in leaf order; of each node its rows, centre, radius, children and smallest id."""
    order = np.arange(len(ids))
    nodes: list[list] = []  # begin, end, left, right

    def grow(begin: int, end: int) -> int:
        at = len(nodes)
        nodes.append([begin, end, -1, -1])
        own = order[begin:end]
        spread_of = vectors[own]
        far = spread_of[np.argmax(((spread_of - spread_of.mean(axis=0)) ** 2).sum(axis=1))]
        other = spread_of[np.argmax(((spread_of - far) ** 2).sum(axis=1))]
        if end - begin > LEAF_ROWS and (other != far).any():
            middle = (end - begin) // 2
            order[begin:end] = own[np.argsort(spread_of @ (other - far), kind="stable")]
            nodes[at][2] = grow(begin, begin + middle)
            nodes[at][3] = grow(begin + middle, end)
        return at

    grow(0, len(ids))
    ids, vectors = ids[order], vectors[order]
    centres = np.array([vectors[a:b].mean(axis=0) for a, b, _, _ in nodes])
    radii = np.array([np.sqrt(((vectors[a:b] - c) ** 2).sum(axis=1).max()) for (a, b, _, _), c in zip(nodes, centres)])
    least = np.array([ids[a:b].min() for a, b, _, _ in nodes])
    return {"ids": ids, "vectors": vectors, "nodes": np.array(nodes), "centres": centres, "radii": radii, "least": least}


def _scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 2**53 by Python's integers."""
    if np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * len(query) < _EXACT:
        return vectors @ query
    whole = [int(x) for x in query]
    return np.array([sum(int(a) * b for a, b in zip(row, whole)) for row in vectors], object)


def search(
    tree: dict[str, np.ndarray], query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: tuple[int, int] | None,
    leaves: int | None = None,
) -> list[tuple[int, int]]:
    """The k best (score, -id) of a shard that are not below ``floor``, best nodes first.

    ``bounds`` are the nodes' upper bounds of the inner product. A node is left out if
    no row in it could pass the worst of k found so far or ``floor``, which another
    shard has already reached: by its bound, or, on a tie, by its smallest id.
    """
    best: list[tuple[int, int]] = []  # heap, worst first
    nodes, least = tree["nodes"], tree["least"]
    heap = [(-bounds[0], 0)]
    seen = 0
    while heap:
        bound, at = heapq.heappop(heap)
        limit = best[0] if len(best) == k else None
        if floor is not None and (limit is None or floor > limit):
            limit = floor
        if limit is not None and -bound < limit[0]:
            break
        if limit is not None and (-bound, -int(least[at])) < limit:
            continue
        begin, end, left, right = nodes[at]
        if left >= 0:
            heapq.heappush(heap, (-bounds[left], int(left)))
            heapq.heappush(heap, (-bounds[right], int(right)))
            continue
        scores, ids = _scores(tree["vectors"][begin:end], query), tree["ids"][begin:end]
        for i in np.flatnonzero(scores >= limit[0]) if limit is not None else range(end - begin):
            found = (int(scores[i]), -int(ids[i]))
            if ids[i] == query_id or floor is not None and found < floor:
                continue
            if len(best) < k:
                heapq.heappush(best, found)
            elif found > best[0]:
                heapq.heapreplace(best, found)
        seen += 1
        if leaves is not None and seen >= leaves and len(best) == k:
            break
    return best


def _pairs(blocks: DataFrame, shards: DataFrame, groups: int) -> DataFrame:
    """Every block of queries beside every shard: blocks are copied once per group of shards."""
    blocks = blocks.select("block", "queries", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    return shards.select("tree", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int").alias("group")).join(blocks, "group")


def _searched(pairs: DataFrame, k: int, leaves: int | None) -> DataFrame:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def of(tree: dict, block: dict) -> Iterator[tuple]:
        wide = max(tree["vectors"].shape[1], block["vectors"].shape[1])
        fill = lambda m: np.pad(m, ((0, 0), (0, wide - m.shape[1])))
        queries = fill(block["vectors"])
        tree = tree | {"vectors": fill(tree["vectors"]), "centres": fill(tree["centres"])}
        norms = np.sqrt((queries**2).sum(axis=1))
        bounds = queries @ tree["centres"].T + norms[:, None] * tree["radii"]
        # rounding of the bound is far below this share; scores are integers
        slack = 1e-9 * (norms[:, None] * (np.sqrt((tree["centres"] ** 2).sum(axis=1)) + tree["radii"]) + 1)
        bounds = np.floor(bounds + slack)
        for i, query_id in enumerate(block["ids"].tolist()):
            floor = (int(block["scores"][i]), -int(block["last"][i])) if block["known"][i] else None
            for score, vec_id in search(tree, query_id, queries[i], bounds[i], k, floor, leaves):
                yield query_id, -vec_id, score

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for tree, block in zip(batch.column("tree"), batch.column("queries")):
                rows = list(of(_unpacked(tree.as_py()), _unpacked(block.as_py())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return pairs.select("tree", "queries").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """Rows of packed queries: ids, vectors, and the kth score known so far."""
    schema = pa.schema([("block", pa.int64()), ("queries", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        known = table.column("score").is_valid().to_numpy()
        vectors = table.column("v").combine_chunks()
        data = _packed(
            ids=table.column("k").to_numpy(), vectors=_matrix(vectors, 1.0), known=known,
            scores=table.column("score").fill_null(0).to_numpy(), last=table.column("last").fill_null(0).to_numpy(),
        )
        return pa.Table.from_pylist([{"block": table.column("block")[0].as_py(), "queries": data}], schema=schema)

    placed = queries.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)))
    return placed.groupBy("block").applyInArrow(pack, "block bigint, queries binary")


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of every query, ties to the smaller id.

    Components are floor(scale * x) and scores are exact integers. Candidates are all
    rows but those with the query's own id. Rows with a null id, a null vector, or null
    or non-finite components take no part, neither do they ask. Shorter vectors count
    as filled with zeros. Rows that repeat an id are candidates each; of queries that
    repeat one, that with the smallest vector asks. Scores beyond a bigint are an error.

    Every task builds trees over its own rows, a few thousand each, without a shuffle.
    Blocks of queries meet every shard twice: first only in its most promising leaf,
    which gives a kth score per query over all shards; then, with that score
    shared, in full.
    """
    spark = vectors.sparkSession
    prepare(spark)
    schema = pa.schema([("shard", pa.int64()), ("tree", pa.binary())])

    def trees(batches: Batches) -> Batches:
        part, number, ids, parts, rows = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            wide = max(m.shape[1] for m in parts)
            data = build(np.concatenate(ids), np.concatenate([np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in parts]))
            return pa.RecordBatch.from_pylist([{"shard": (part << 32) + number, "tree": _packed(**data)}], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                piece = batch.slice(at, SHARD_ROWS)
                ids.append(piece.column(0).to_numpy())
                parts.append(_matrix(piece.column(1), scale))
                rows += piece.num_rows
                if rows >= SHARD_ROWS:
                    yield shard()
                    number, ids, parts, rows = number + 1, [], [], 0
        if rows:
            yield shard()

    rows = spread(vectors.select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v"))).where(F.col("k").isNotNull() & usable("v"))
    shards = materialise(rows.mapInArrow(trees, "shard bigint, tree binary"), "trees")
    asked = queries.select(F.col(key).cast("bigint").alias("k"), F.col(vector).alias("v")).where(F.col("k").isNotNull() & usable("v"))
    asked = asked.groupBy("k").agg(F.min("v").alias("v"))
    asked = materialise(asked.withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double"))), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    groups = max(1, min(shards.count(), 4 * spark.sparkContext.defaultParallelism))
    unknown = F.lit(None).cast("bigint")
    first = _searched(_pairs(_blocks(asked.withColumns({"score": unknown, "last": unknown}), blocks), shards, groups), k, leaves=1)
    kth = materialise(_best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("k"), "score", F.col("vec_id").alias("last")), "kth")
    found = _searched(_pairs(_blocks(asked.join(kth, "k", "left").select("k", "v", "score", "last"), blocks), shards, groups), k, leaves=None)
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
