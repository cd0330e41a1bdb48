"""Token ids in bit-packed binary files, written and read in document order."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import Batches, new_file, open_store, prepare, rows_to_batches, text_bytes
from corpusloom.llm.tokens import read_definition, word_encoder
from corpusloom.session import materialise, work_folder

# File layout, all numbers little-endian:
#   head    8 bytes MAGIC, u32 bits per id, u32 ids per block
#   blocks  ids packed from the lowest bit on; every block starts at a byte
#   foot    u64 offset of every block and of the end; i64 key, u8 key is known, u64 first id of every document
#   tail    u64 ids, u64 documents, u64 blocks, u64 offset of the foot, 8 bytes MAGIC
MAGIC = b"PACKIDS1"
HEAD, TAIL = struct.Struct("<8sII"), struct.Struct("<QQQQ8s")
BLOCK_IDS = 4096


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spread[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from the one numbered ``first``: a window of five bytes each, shifted and cut."""
    raw = np.frombuffer(data + b"\0" * 5, np.uint8)
    at = np.arange(first, first + count, dtype=np.int64) * bits
    place = at >> 3
    value = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        value |= raw[place + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class PackedWriter:
    """Writes documents one after the other; holds one block of ids and the index."""

    def __init__(self, out: pa.NativeFile, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.rest = np.zeros(0, np.uint32)
        self.offsets, self.keys, self.known, self.starts = [HEAD.size], [], [], []
        self.ids = 0
        out.write(HEAD.pack(MAGIC, bits, block_ids))

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key or 0)
        self.known.append(key is not None)
        self.starts.append(self.ids)
        self.ids += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // self.block_ids * self.block_ids
        for at in range(0, whole, self.block_ids):
            self._block(self.rest[at : at + self.block_ids])
        self.rest = self.rest[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        for values, kind in ((self.offsets, "<u8"), (self.keys, "<i8"), (self.known, "u1"), (self.starts, "<u8")):
            self.out.write(np.asarray(values, kind).tobytes())
        self.out.write(TAIL.pack(self.ids, len(self.keys), len(self.offsets) - 1, self.offsets[-1], MAGIC))
        self.out.close()


class PackedFile:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        head, self.bits, self.block_ids = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        self.ids, self.documents, blocks, foot, tail = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if head != MAGIC or tail != MAGIC:
            raise ValueError(f"{uri} is not a whole file of packed ids")
        index = self.file.read_at(size - TAIL.size - foot, foot)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1)
        at = self.offsets.nbytes
        self.keys = np.frombuffer(index, "<i8", self.documents, at)
        self.known = np.frombuffer(index, "u1", self.documents, at + self.keys.nbytes)
        self.starts = np.append(np.frombuffer(index, "<u8", self.documents, at + 9 * self.documents), np.uint64(self.ids))
        self._held: tuple[int, int, bytes] = (0, 0, b"")

    def key(self, i: int) -> int | None:
        return int(self.keys[i]) if self.known[i] else None

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document; only its blocks are read."""
        return self.slice(int(self.starts[i]), int(self.starts[i + 1]))

    def slice(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids + 1
        if not (self._held[0] <= first and last <= self._held[1]):  # read ahead: small documents share blocks
            ahead = min(max(last, first + 64), len(self.offsets) - 1)
            a, b = int(self.offsets[first]), int(self.offsets[ahead])
            self._held = (first, ahead, self.file.read_at(b - a, a))
        held, _, data = self._held
        base = int(self.offsets[held])
        parts = []
        for block in range(first, last):
            a, b = max(start, block * self.block_ids), min(stop, (block + 1) * self.block_ids)
            piece = data[int(self.offsets[block]) - base : int(self.offsets[block + 1]) - base]
            parts.append(unpack(piece, self.bits, a - block * self.block_ids, b - a))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_token_files(
    documents: DataFrame, tokenizer: str, end_id: int, vocabulary: int, key: str = "doc_id", text: str = "text",
    block_ids: int = BLOCK_IDS, folder: str | None = None,
) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the ids; the manifest ``path, first, ids, documents``.

    The texts are range-sorted by key (nulls first) and one file is written per range, so
    the files, ordered by ``first`` (their smallest key), hold all ids in ascending key
    order. ``tokenizer`` is the path of a tokenizer file that drops white space. Rows of
    equal keys keep no particular order, in one file; a null text is empty. Ranges
    without rows leave no file. The manifest is written by Spark: files of attempts
    that were lost are in no manifest.
    """
    spark = documents.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(read_definition(tokenizer))
    folder = folder or work_folder(spark, "tokens")
    bits = bits_for(vocabulary)
    schema = pa.schema([("path", pa.string()), ("first", pa.int64()), ("ids", pa.int64()), ("documents", pa.int64())])

    def run(batches: Batches) -> Batches:
        encoder, end = word_encoder(shared.value), np.uint32(end_id)
        writer, path = None, ""
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1).to_pylist())):
                if writer is None:
                    path, out = new_file(folder, ".ids")
                    writer = PackedWriter(out, bits, block_ids)
                writer.add(k, np.append(np.frombuffer(ids, "<u4"), end))
        if writer is not None:
            writer.close()
            first = writer.keys[0] if writer.known[0] else None
            yield pa.RecordBatch.from_pylist(
                [{"path": path, "first": first, "ids": writer.ids, "documents": len(writer.keys)}], schema=schema
            )

    rows = documents.select(F.col(key).cast("bigint").alias("k"), text_bytes(text).alias("t"))
    placed = rows.repartitionByRange("k").sortWithinPartitions("k")
    return materialise(placed.mapInArrow(run, "path string, first bigint, ids bigint, documents bigint"), "manifest")


def read_token_files(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32, path`` of every document, from the files of a manifest.

    ``start`` counts the ids of all documents before it. One row per file is
    collected to number the files; the documents stay in the tasks.
    """
    spark = manifest.sparkSession
    prepare(spark)
    files = manifest.select("path", "first", "ids").collect()
    files.sort(key=lambda f: (f["first"] is not None, f["first"] or 0, f["path"]))
    listed, total = [], 0
    for f in files:
        listed.append((f["path"], total))
        total += f["ids"]
    schema = pa.schema([
        ("k", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("path", pa.string()),
    ])

    def documents_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        for uri, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            file = PackedFile(uri)
            for i in range(file.documents):
                ids = file.document(i)
                yield file.key(i), offset + int(file.starts[i]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), uri

    def run(batches: Batches) -> Batches:
        return rows_to_batches(batches, schema, documents_of)

    placed = spark.createDataFrame(listed, "path string, offset bigint").repartition(max(1, len(listed)))
    return placed.mapInArrow(
        run, "k bigint, start bigint, n_tokens bigint, ids_crc32 bigint, path string"
    ).withColumnRenamed("k", key)
