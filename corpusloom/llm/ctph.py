"""Context-triggered piecewise hashing: fingerprints of texts and their likeness."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import Batches, prepare, rows_to_batches, text_bytes


WINDOW = 7
SIGNS = 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
# signatures without a common run of this length are unlike
COMMON_RUN = 4
_BLOCK = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, np.uint64)
_POWERS = [np.uint64(pow(int(_FACTOR), k, 1 << 64)) for k in range(WINDOW)]


def _boundaries(data: bytes, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all sizes from 2**level on: position behind the trigger, and leading zeros of the rolling hash."""
    raw = np.frombuffer(data, np.uint8)
    ends, hashes = [], []
    for at in range(0, len(raw), _BLOCK):
        begin = max(0, at - WINDOW + 1)
        values = _BYTES[raw[begin : at + _BLOCK]]
        rolling = values.copy()
        for k in range(1, min(WINDOW, len(values))):
            rolling[k:] += values[:-k] * _POWERS[k]
        rolling = rolling[at - begin :]
        found = np.flatnonzero(rolling < np.uint64(1 << (64 - level)) if level else np.ones(len(rolling), bool))
        ends.append(found + at + 1)
        hashes.append(rolling[found])
    return np.concatenate(ends), np.concatenate(hashes)


def _signature(data: bytes, ends: np.ndarray) -> str:
    cuts = [0, *ends.tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    return "".join(ALPHABET[zlib.crc32(data[a:b]) & 63] for a, b in zip(cuts, cuts[1:]))


def fingerprint(data: bytes) -> str:
    """``size:signature:signature`` at block size and at twice the block size; of an empty text ``0::``.

    A chunk ends where the hash of the last seven bytes starts with enough zero bits,
    one more for every doubling of the size. The block size is the smallest near the
    length over 64 with fewer than 64 boundaries; every chunk gives one of 64 letters.
    """
    if not data:
        return "0::"
    level = max(0, (len(data) // SIGNS).bit_length() - 3)
    ends, hashes = _boundaries(data, level)
    while True:
        kept = hashes < np.uint64(1 << (64 - level)) if level else np.ones(len(hashes), bool)
        if np.count_nonzero(kept) < SIGNS or level == 63:
            break
        level += 1
    fine = ends[kept][: SIGNS - 1]
    coarse = ends[hashes < np.uint64(1 << (63 - level))][: SIGNS - 1]
    return f"{1 << level}:{_signature(data, fine)}:{_signature(data, coarse)}"


def _alike(a: str, b: str) -> float:
    """1 less the edit distance (insertions and deletions) over both lengths."""
    if a == b:
        return 1.0
    run = min(COMMON_RUN, len(a), len(b))
    if not run or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << i
    mask = whole = (1 << len(a)) - 1
    for letter in b:  # zeros of the mask mark a longest common subsequence
        met = mask & places.get(letter, 0)
        mask = (mask + met | mask - met) & whole
    common = len(a) - mask.bit_count()
    return 2 * common / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1: the best likeness of signatures at the same block size; 0 if there is none."""
    if one == other:
        return 1.0
    size1, *signs1 = one.split(":")
    size2, *signs2 = other.split(":")
    found = 0.0
    for size, sign in zip((int(size1), 2 * int(size1)), signs1):
        for size_, sign_ in zip((int(size2), 2 * int(size2)), signs2):
            if size == size_ and sign and sign_:
                found = max(found, _alike(sign, sign_))
    return found


def _placed(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``part, tail, k, t``: rows in ranges of the key, each followed by the first row of the next range.

    The cuts are quantiles of the key alone. Only ids are aggregated and collected, one
    per range; a text is moved once, and the first of a range once more. Rows
    without a key have no place in the order and are spread over parts below zero.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(key).cast("bigint").alias("k"), text_bytes(text).alias("t"))
    keys = rows.select(F.col("k").cast("double").alias("x"), "k").where("k is not null")
    cuts = sorted(set(keys.approxQuantile("x", [i / parts for i in range(1, parts)], 0.001) if parts > 1 else []))

    def bucketed(frame: DataFrame) -> DataFrame:
        if not cuts:
            return frame.withColumn("part", F.lit(0.0))
        return Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="x", outputCol="part").transform(frame)

    firsts = bucketed(keys).groupBy("part").agg(F.min("k").alias("first")).orderBy("first").collect()
    before = [(r["first"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]  # the first of all follows the last
    copies = documents.sparkSession.createDataFrame(before, "first bigint, before double")
    placed = bucketed(rows.where("k is not null").withColumn("x", F.col("k").cast("double")))
    placed = placed.join(F.broadcast(copies), F.col("k") == F.col("first"), "left").select(
        "k", "t",
        F.explode(F.array_compact(F.array(
            F.struct("part", F.lit(False).alias("tail")),
            F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(True).alias("tail"))),
        ))).alias("at"),
    ).select("at.part", "at.tail", "k", "t")
    loose = rows.where("k is null").select(
        (-1.0 - F.pmod(F.xxhash64("t", F.monotonically_increasing_id()), F.lit(parts))).alias("part"), F.lit(False).alias("tail"), "k", "t"
    )
    return placed.union(loose).repartitionByRange(parts, "part").sortWithinPartitions("part", "tail", "k", "t")


FINGERPRINT_SCHEMA = (
    "k bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness.

    The edited text has the second half of the code points (the last floor(n / 2))
    replaced by the first as many of the next text in ascending key order, the last
    text being followed by the first. ``near_edited`` compares both fingerprints,
    ``near_next`` those of the text and of the next one. Rows of equal keys follow
    each other by text. A row with a null key has no next text: it is fingerprinted, its
    edited columns and likenesses are null. A null text is empty.
    """
    prepare(documents.sparkSession)
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in FINGERPRINT_SCHEMA.split(", ")])
    held: list = []  # the row that waits for the next one: part, key, text, its fingerprint

    def ended(next_text: str | None, next_mark: str | None) -> tuple:
        _, k, own, mark = held
        if next_text is None:
            return k, len(own), None, mark, None, None, None
        half = len(own) // 2
        edited = (own[: len(own) - half] + next_text[:half]).encode("utf-8", "surrogatepass")
        edited_mark = fingerprint(edited)
        return (
            k, len(own), hashlib.sha256(edited).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, next_mark),
        )

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        for part, tail, k, t in zip(*batch.columns):
            part, data = part.as_py(), t.as_py()
            if tail.as_py() and not held:
                continue  # a repeated copy of the next range's first key
            own, mark = data.decode("utf-8", "replace"), fingerprint(data)
            if held and held[0] == part:
                yield ended(own, mark)
            held[:] = [] if tail.as_py() else [part, k.as_py(), own, mark]
            if part < 0:
                yield ended(None, None)
                held.clear()

    def run(batches: Batches) -> Batches:
        held.clear()
        return rows_to_batches(batches, schema, rows_of)

    return _placed(documents, key, text).mapInArrow(run, FINGERPRINT_SCHEMA).withColumnRenamed("k", key)
