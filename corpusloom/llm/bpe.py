"""Byte-level BPE: encoding by a queue of merges over a linked list, decoding by vocabulary strings."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import Batches, hold, prepare, rows_to_batches, text_bytes
from corpusloom.llm.tokens import BYTE_CHARACTERS, Generations, read_definition

# fixed value: the pattern of byte-level pre-tokenizers
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHED_PIECES = 300_000
_SHIFT = 20
# A space behind white space: only there can a word's ids depend on what stands before its space
_RUN = re.compile(r"\s ")
_WORD_ENDS = re.compile(r"(?<=\S)(?= )")


class _Cached(Generations):
    def __init__(self, make, limit: int):
        super().__init__(limit)
        self.make = make


class ByteBpe:
    """Encodes as the file's own library does without added tokens at the ends, and decodes.

    Special tokens that stand in a text become their ids. ``encode`` gives little-endian
    unsigned 32-bit integers. Words are cached with the space before them; a miss is cut
    by the pattern and each part is merged.
    """

    def __init__(self, definition: str, limit: int = CACHED_PIECES):
        read = json.loads(definition)
        model = read["model"]
        vocabulary: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        # both ids of a pair in one number, to its rank and the id of the merged symbol in one number
        self.merges = {
            vocabulary[a] << _SHIFT | vocabulary[b]: rank << _SHIFT | vocabulary[a + b] for rank, (a, b) in enumerate(pairs)
        }
        self.first = [vocabulary[chr(BYTE_CHARACTERS[b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in read.get("added_tokens", [])}
        names = sorted(self.special, key=len, reverse=True)
        self.find_special = re.compile("(" + "|".join(map(re.escape, names)) + ")" if names else "(?!)")
        byte_of = {chr(c): b for b, c in BYTE_CHARACTERS.items()}
        # a vocabulary string as bytes; special tokens stand for their own text
        self.strings = {i: bytes(byte_of[c] for c in s) for s, i in vocabulary.items() if all(c in byte_of for c in s)}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.find = regex.compile(PATTERN).findall
        self.part = _Cached(self._merged, limit // 2)
        self.piece = _Cached(lambda text: b"".join(map(self.part.__getitem__, self.find(text))), limit)
        self.spaced = _Cached(lambda text: b"".join(map(self.part.__getitem__, self.find(" " + text))), limit)

    def _merged(self, part: str) -> bytes:
        return array("I", self.merge([self.first[b] for b in part.encode("utf-8", "surrogatepass")])).tobytes()

    def merge(self, ids: list[int]) -> list[int]:
        """Merge neighbours, always the pair of lowest rank, leftmost first.

        The queue holds (rank, place) with the pair seen there. An entry is stale, and
        skipped, if one of its symbols has been merged since.
        """
        count = len(ids)
        if count < 2:
            return ids
        merges = self.merges
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        queue = []
        for at in range(count - 1):
            pair = ids[at] << _SHIFT | ids[at + 1]
            if (found := merges.get(pair)) is not None:
                queue.append((found >> _SHIFT, at, pair))
        heapify(queue)
        gone = -1
        while queue:
            _, at, pair = heappop(queue)
            right = after[at]
            if right >= count or ids[at] << _SHIFT | ids[right] != pair or ids[at] == gone:
                continue
            ids[at] = merges[pair] & ((1 << _SHIFT) - 1)
            ids[right] = gone
            after[at] = follows = after[right]
            if follows < count:
                before[follows] = at
                pair = ids[at] << _SHIFT | ids[follows]
                if (found := merges.get(pair)) is not None:
                    heappush(queue, (found >> _SHIFT, at, pair))
            if (left := before[at]) >= 0:
                pair = ids[left] << _SHIFT | ids[at]
                if (found := merges.get(pair)) is not None:
                    heappush(queue, (found >> _SHIFT, left, pair))
        return [i for i in ids if i != gone]

    def _section(self, text: str) -> bytes:
        if _RUN.search(text):
            return b"".join(map(self.piece.__getitem__, _WORD_ENDS.split(text)))
        first, *rest = text.split(" ")
        return self.piece[first] + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        parts = self.find_special.split(text) if self.special else [text]
        return b"".join(
            self.special[part].to_bytes(4, "little") if n % 2 else self._section(part) for n, part in enumerate(parts) if part
        )

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings one after the other; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def codec(definition: str) -> ByteBpe:
    """The worker's codec for a tokenizer file's content; kept between tasks."""
    return hold(("bytes", definition), lambda: ByteBpe(definition))


def with_token_ids(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``key, ids, decoded`` of every whole text: its token ids (array) and, if asked for, the text decoded from them."""
    return _encoded(
        documents, tokenizer, key, text, "ids array<bigint>, decoded string", [pa.list_(pa.int64()), pa.string()],
        lambda bpe, ids: (ids.tolist(), bpe.decode(ids.tolist()) if decoded else None),
    )


def token_digests(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every whole text: what encoding and decoding give, as digests.

    A null text is empty; rows with a null key and repeated rows are kept; an empty table
    gives an empty result. A very long text is held by one task, with its ids.
    """
    return _encoded(
        documents, tokenizer, key, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        [pa.int64(), pa.string(), pa.string()],
        lambda bpe, ids: (
            len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids.tolist()).encode()).hexdigest(),
        ),
    )


def _encoded(documents: DataFrame, tokenizer: str, key: str, text: str, columns: str, kinds: list, made) -> DataFrame:
    prepare(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(read_definition(tokenizer))
    schema = pa.schema([("k", pa.int64()), *((c.split()[0], kind) for c, kind in zip(columns.split(", "), kinds))])

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        bpe = codec(shared.value)
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.frombuffer(bpe.encode(t.as_py().decode("utf-8", "replace")), "<u4")
            yield k, *made(bpe, ids)

    def run(batches: Batches) -> Batches:
        return rows_to_batches(batches, schema, rows_of)

    rows = documents.select(F.col(key).cast("bigint").alias("k"), text_bytes(text).alias("t"))
    return rows.mapInArrow(run, f"k bigint, {columns}").withColumnRenamed("k", key)
