"""Near-duplicates by SimHash; candidates by pigeonring filtering."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.llm.common import Batches, prepare, release, rows_to_batches, text_bytes
from corpusloom.llm.components import connected_components
from corpusloom.session import materialise

SEED = 42
# Buckets of more fingerprints are linked through their one-bit neighbours, not in pairs
PAIRED = 8
_BLOCK = 1 << 16


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    pieces = (joined[a:b] for a, b in zip(starts, ends))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """64-bit fingerprint, as a signed number: a bit is 1 if set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``key, fp`` for every row: the SimHash of its whole text over shingles of ``width`` words.

    A-Z are lower-cased; words are runs without ASCII white space. A null, empty or
    blank text has fingerprint zero. Rows with a null key and repeated rows are kept.
    """
    prepare(documents.sparkSession)
    schema = pa.schema([("k", pa.int64()), ("fp", pa.int64())])

    def run(batches: Batches) -> Batches:
        release()
        return rows_to_batches(
            batches, schema,
            lambda batch: (
                (k.as_py(), simhash(shingle_hashes(t.as_py(), width))) for k, t in zip(batch.column(0), batch.column(1))
            ),
        )

    rows = documents.select(F.col(key).cast("bigint").alias("k"), text_bytes(text).alias("t"))
    return rows.mapInArrow(run, "k bigint, fp bigint").withColumnRenamed("k", key)


class Pigeonring:
    """The bounds of one search: 64 bits in ``segments`` boxes on a ring, at most ``radius`` differing bits.

    If two fingerprints differ in at most ``radius`` bits, some start on the ring has
    a chain whose first l boxes differ in at most l * radius / segments bits, for every l.
    The first boxes with a budget of zero make the equality key of that start.
    """

    def __init__(self, radius: int, segments: int | None = None):
        self.radius = radius
        self.segments = segments = segments or 2 * radius + 1
        if not radius < segments <= 64:
            raise ValueError("there must be more segments than differing bits, and 64 at most")
        cuts = [64 * i // segments for i in range(segments + 1)]
        boxes = [sum(1 << bit for bit in range(a, b)) for a, b in zip(cuts, cuts[1:])]
        self.budgets = [(n * radius) // segments for n in range(segments + 1)]
        self.fixed = max(n for n in range(1, segments) if self.budgets[n] == 0)
        # chains[i][n]: mask of n boxes from start i
        self.chains = [
            [sum(boxes[(i + j) % segments] for j in range(n)) for n in range(segments + 1)] for i in range(segments)
        ]

    def key(self, fp: str) -> Column:
        """Array of (start, bits of its fixed boxes)."""
        return F.array(*(
            F.struct(F.lit(i).alias("start"), F.col(fp).bitwiseAND(_mask(chain[self.fixed])).alias("bits"))
            for i, chain in enumerate(self.chains)
        ))

    def _holds(self, i: int, x: Column) -> Column:
        kept = F.lit(True)
        for n in range(self.fixed, self.segments):
            if n == self.fixed or self.budgets[n + 1] > self.budgets[n]:  # the longest chain of each budget
                longest = max(k for k in range(n, self.segments) if self.budgets[k] == self.budgets[n])
                kept = kept & (F.bit_count(x.bitwiseAND(_mask(self.chains[i][longest]))) <= self.budgets[n])
        return kept

    def first_start(self, x: Column) -> Column:
        """The first start whose chains all keep their budgets; null without one."""
        found = F.lit(None).cast("int")
        for i in reversed(range(self.segments)):
            found = F.when(self._holds(i, x), i).otherwise(found)
        return found


def _mask(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("bigint")


def fingerprint_links(fingerprints: DataFrame, radius: int = 2, segments: int | None = None) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that differ in at most ``radius`` bits.

    Buckets of one key hold fingerprints that agree in the fixed boxes of a start.
    Buckets of up to PAIRED members are compared in pairs: the budgets of longer
    chains prune, then the full Hamming distance decides. Members of larger buckets
    would make too many pairs; they meet at common neighbours (at most half the
    radius away) instead, and each is linked to the smallest fingerprint there, so
    that the components are the same. No link's ends are ever in different components.
    """
    if radius > 2:
        raise ValueError("hot buckets are linked through common neighbours, which needs a radius of at most 2 bits")
    ring = Pigeonring(radius, segments)
    chains = materialise(
        fingerprints.select("fp").distinct().select("fp", F.explode(ring.key("fp")).alias("k")).select("fp", "k.*"), "chains"
    )
    sizes = materialise(chains.groupBy("start", "bits").count().where("count > 1"), "buckets")
    chains = chains.join(sizes, ["start", "bits"])
    chains = materialise(chains, "chains")
    left, right = chains.where(f"count <= {PAIRED}"), chains.where(f"count <= {PAIRED}").withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (
        left.withColumnRenamed("fp", "a").drop("count").join(right.drop("count"), ["start", "bits"]).where("a < b")
        .where(ring.first_start(x) == F.col("start")).where(F.bit_count(x) <= radius).select("a", "b")
    )
    hot = chains.where(f"count > {PAIRED}").select("fp").distinct()
    return pairs.union(neighbour_links(hot, radius))


def neighbour_links(fingerprints: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints through shared neighbours: linear in the rows, no pairs.

    Two fingerprints within 2 bits share one within 1 bit of both, and the reverse. At
    most 65 fingerprints meet at one neighbour, so the window has no hot group.
    """
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(_mask(1 << bit)) for bit in range(64)))
    met = fingerprints.select("fp", F.explode(flips).alias("at"))
    least = F.min("fp").over(Window.partitionBy("at"))
    links = met.select(F.col("fp").alias("b"), least.alias("a")).where("a < b").select("a", "b").distinct()
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _roots(fingerprints: DataFrame, radius: int) -> DataFrame:
    """``fp, root`` of every fingerprint that is linked to another; root is the smallest of its component."""
    roots = connected_components(fingerprint_links(fingerprints, radius)).withColumnsRenamed({"id": "fp"})
    return materialise(roots, "roots")


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2
) -> DataFrame:
    """``key, fp, component_id`` for every row.

    ``component_id`` is the smallest key reachable over links of fingerprints that
    differ in at most ``radius`` bits; equal fingerprints are linked. Equal
    fingerprints are reduced to one before they are compared. Rows with a null key get
    a fingerprint and the component of their texts; they name no component unless all
    its keys are null. Repeated rows are kept; an empty table gives an empty result.
    """
    marked = materialise(with_fingerprints(documents, key, text, width), "fingerprints")
    first = materialise(marked.groupBy("fp").agg(F.min(key).alias("first")), "first")
    roots = _roots(first, radius)
    least = materialise(
        roots.join(first, "fp").groupBy("root").agg(F.min("first").alias("component_id")), "components"
    )
    linked = materialise(roots.join(least, "root").select("fp", "component_id"), "components")
    named = first.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return marked.join(materialise(named, "components"), "fp").select(key, "fp", "component_id")


def without_near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2
) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all its columns whatever their names.

    The row of the smallest key stays, of repeated rows one, and a null key only where
    the component has no other.
    """
    rows = materialise(
        documents.select(
            F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("document"), F.monotonically_increasing_id().alias("row")
        ),
        "documents",
    )
    told = rows.select("row", F.col(f"document.`{key}`").alias("id"), F.col(f"document.`{text}`").alias("text"))
    marked = materialise(with_fingerprints(told.select("row", "text"), "row", "text", width), "fingerprints")
    named = marked.join(told.select("row", F.struct(F.col("id").isNull().alias("missing"), "id", "row").alias("least")), "row")
    first = materialise(named.groupBy("fp").agg(F.min("least").alias("least")), "first")
    group = F.coalesce("root", "fp").alias("root")
    kept = first.join(_roots(first, radius), "fp", "left").groupBy(group).agg(F.min("least").alias("least"))
    # the same plan at any size: whole documents meet their thin partners in a shuffle, once
    return rows.join(materialise(kept.select("least.row"), "kept").hint("merge"), "row", "left_semi").select("document.*")
