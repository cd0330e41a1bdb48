"""Documents packed into sequences of tokens: bin completion over the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import Batches, prepare, release, rows_to_batches, text_bytes
from corpusloom.llm.tokens import CACHED_WORDS, read_definition, word_encoder
from corpusloom.operators.keys import assign_seq
from corpusloom.session import materialise

# A filling and how many sequences have it; its lengths are in descending order
Plan = list[tuple[tuple[int, ...], int]]
# Fillings that the searches look at before the best plan so far is taken
STEPS = 50_000
# Orders of the searches: whether a branch tries small lengths first, by its depth and in turn
SMALL_FIRST = ((False,), (True,), (False, True), (False, False, True), (True, True, False))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No plan has fewer sequences: total length, and lengths that cannot share a sequence."""
    lengths = np.arange(capacity + 1)
    mass = counts * lengths
    best = -(-int(mass.sum()) // capacity)
    n, s = np.cumsum(counts), np.cumsum(mass)
    half = capacity // 2
    for k in range(half + 1):
        n1 = int(n[capacity] - n[capacity - k])
        n2, s2 = int(n[capacity - k] - n[half]), int(s[capacity - k] - s[half])
        s3 = int(s[half] - (s[k - 1] if k else 0))
        best = max(best, n1 + n2 + max(0, -(-(s3 - (n2 * capacity - s2)) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing; sequences filled alike are handled together."""
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):  # as many new sequences as are needed, each filled with this length
                each = min(left, capacity // length)
                filling, number, room = (length,) * each, left // each, capacity - each * length
                left -= each * number
            else:
                room = rooms[i]
                group = open_[room][-1]
                each = min(room // length, left)
                number = min(group[1], left // each)
                filling, room = group[0] + (length,) * each, room - each * length
                group[1] -= number
                left -= each * number
                if not group[1]:
                    open_[rooms[i]].pop()
                    if not open_[rooms[i]]:
                        del open_[rooms.pop(i)]
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append([filling, number])
    return [(filling, number) for groups in open_.values() for filling, number in groups]


class Steps:
    """The steps left to a search."""

    def __init__(self, left: int):
        self.left = left

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0


def _reachable(counts: np.ndarray, room: int, small: bool) -> tuple[list[int], list[int]]:
    """Available lengths up to ``room`` and before each and after all the sums (as bits) that they reach.

    The last lengths are used first: the large ones, or with ``small`` the small ones.
    """
    lengths = (np.flatnonzero(counts[1 : room + 1]) + 1).tolist()[:: -1 if small else 1]
    mask, sums = (1 << room + 1) - 1, [1]
    for length in lengths:
        bits, left, take = sums[-1], min(int(counts[length]), room // length), 1
        while left > 0:  # 1, 2, 4 ... copies and the rest give every number of copies
            take = min(take, left)
            bits |= bits << take * length & mask
            left -= take
            take *= 2
        sums.append(bits)
    return lengths, sums


def _exact(lengths: list[int], sums: list[int], counts: np.ndarray, target: int, upto: int) -> Iterator[tuple[int, ...]]:
    """Multisets of the first ``upto`` lengths with this sum, the last of them first; no dead ends."""
    if target == 0:
        yield ()
        return
    for i in range(upto, 0, -1):
        if not sums[i] >> target & 1:
            return
        length = lengths[i - 1]
        for copies in range(min(int(counts[length]), target // length), 0, -1):
            if sums[i - 1] >> target - copies * length & 1:
                for rest in _exact(lengths, sums, counts, target - copies * length, i - 1):
                    yield (length,) * copies + rest


def _dominated(filling: tuple[int, ...], counts: np.ndarray, waste: int, pairs: bool) -> bool:
    """With what the filling leaves, a longer length could stand for one (or two) of its own, or one more would fit."""
    counts = counts.copy()
    np.subtract.at(counts, np.array(filling, np.int64), 1)
    distinct = sorted(set(filling))
    if waste and (counts[1 : waste + 1].any() or any(counts[s + 1 : s + waste + 1].any() for s in distinct)):
        return True
    sums = {a + b for i, a in enumerate(distinct) for b in distinct[i:] if a != b or filling.count(a) > 1} if pairs else ()
    return any(counts[s : s + waste + 1].any() for s in sums)


def fillings(counts: np.ndarray, room: int, most_waste: int, steps: Steps, small: bool = False) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of the room beside the largest length, least waste first, any number of lengths.

    A length of exactly the room dominates all others. Only sums that the available lengths
    reach are looked at.
    """
    if room and counts[room] > 0:
        yield (room,)
        return
    lengths, sums = _reachable(counts, room, small)
    for waste in range(min(most_waste, room) + 1):
        if not sums[-1] >> room - waste & 1:
            continue
        for filling in _exact(lengths, sums, counts, room - waste, len(lengths)):
            if not steps.take():
                return
            # looking for small lengths, what one large length could stand for is no loss
            if not _dominated(filling, counts, waste, pairs=not small):
                yield filling


def bin_completion(counts: np.ndarray, capacity: int, steps: int = STEPS) -> Plan:
    """Branch and bound for the fewest sequences; ``counts[n]`` pieces have length n, up to ``capacity``.

    Every branch fills the sequence of the largest length left, and repeats that
    filling as often as the counts allow, later once, so a plan has about as many
    fillings as there are lengths, whatever the number of pieces. A branch ends when
    its waste exceeds what the best plan so far (at first best-fit decreasing) leaves for a
    better one. Searches try large or small lengths first (SMALL_FIRST); they end at
    the lower bound, where the plan is proven best, or after ``steps`` steps together.
    """
    best = best_fit(counts, capacity)
    for small in SMALL_FIRST:
        best = _Search(counts, capacity, best, small).run(Steps(steps // len(SMALL_FIRST)))
    return best


class _Search:
    """A depth-first search over fillings, with the counts that are left and the plan that led there."""

    def __init__(self, counts: np.ndarray, capacity: int, best: Plan, small: tuple[bool, ...]):
        self.counts, self.capacity, self.small = counts.astype(np.int64).copy(), capacity, small
        self.total = int((self.counts * np.arange(capacity + 1)).sum())
        self.bound = lower_bound(self.counts, capacity)
        self.best, self.fewest = best, sum(number for _, number in best)
        self.used = self.waste = 0

    def spare(self) -> int:
        """The waste that a plan of one sequence fewer than the best may still have."""
        return (self.fewest - 1) * self.capacity - self.total - self.waste

    def branch(self, depth: int, left: Steps) -> Iterator[tuple]:
        """Fillings of the largest length's sequence, and how often: (filling, number, lengths, copies of each, waste)."""
        largest = int(np.flatnonzero(self.counts)[-1])
        view = self.counts.copy()
        view[largest] -= 1
        for rest in fillings(view, self.capacity - largest, max(0, self.spare()), left, self.small[depth % len(self.small)]):
            filling = (largest, *rest)
            lengths, need = np.unique(filling, return_counts=True)
            own = self.capacity - sum(filling)
            most = int((self.counts[lengths] // need).min())
            if own:
                most = min(most, self.spare() // own)
            if most > 0:
                yield from ((filling, number, lengths, need, own) for number in dict.fromkeys((most, 1)))

    def run(self, left: Steps) -> Plan:
        taken: list[tuple] = []
        open_ = [self.branch(0, left)] if self.fewest > self.bound and self.counts.any() else []
        while open_ and left.left > 0 and self.fewest > self.bound:
            if len(taken) == len(open_):  # back from below
                self._take(taken.pop(), -1)
            found = next(open_[-1], None)
            if found is None:
                open_.pop()
                continue
            left.take()
            if found[4] * found[1] > self.spare():
                continue
            self._take(found, 1)
            taken.append(found)
            if self.counts.any():
                open_.append(self.branch(len(open_), left))
            elif self.used < self.fewest:
                self.fewest, self.best = self.used, [(filling, number) for filling, number, *_ in taken]
        return self.best

    def _take(self, found: tuple, sign: int) -> None:
        _, number, lengths, need, own = found
        self.counts[lengths] -= sign * need * number
        self.used += sign * number
        self.waste += sign * own * number


def token_pieces(
    documents: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text",
    cached_words: int = CACHED_WORDS,
) -> DataFrame:
    """``key, piece, start, length, ids_crc32``: every text's ids with ``end_id``, cut only where longer than ``capacity``."""
    spark = documents.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(read_definition(tokenizer))
    schema = pa.schema([("k", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = int(end_id).to_bytes(4, "little")

    def pieces_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        encoder = word_encoder(shared.value, cached_words)
        for k, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1).to_pylist())):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                yield k, piece, at // 4, len(part) // 4, zlib.crc32(part)

    def run(batches: Batches) -> Batches:
        return rows_to_batches(batches, schema, pieces_of)

    rows = documents.select(F.col(key).cast("bigint").alias("k"), text_bytes(text).alias("t"))
    return rows.mapInArrow(run, "k bigint, piece int, start bigint, length bigint, ids_crc32 bigint").withColumnRenamed("k", key)


def pack_pieces(pieces: DataFrame, capacity: int, order_by: list[str]) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Only the histogram of lengths, at most ``capacity`` numbers, is collected and
    planned. Pieces are numbered in order of length, ties by ``order_by``; a piece's
    number alone tells its filling, sequence and offset.
    """
    spark = pieces.sparkSession
    prepare(spark)
    pieces = materialise(pieces, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    table = spark.sparkContext.broadcast(_slots(bin_completion(counts, capacity), capacity))
    numbered = assign_seq(pieces, "_n", [F.col("length").desc(), *order_by], 0)
    columns = pieces.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id bigint, offset bigint"

    def run(batches: Batches) -> Batches:
        release()
        starts, bases, copies, offsets, lengths = table.value
        for batch in batches:
            n = batch.column(0).to_numpy()
            i = np.searchsorted(starts, n, side="right") - 1
            j = n - starts[i]
            placed = (bases[i] + j // copies[i], offsets[i] + j % copies[i] * lengths[i])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *map(pa.array, placed)], names=[*columns, "sequence_id", "offset"]
            )

    return numbered.select("_n", *columns).mapInArrow(run, schema)


def _slots(plan: Plan, capacity: int) -> tuple[np.ndarray, ...]:
    """Intervals of numbers: start, first sequence, copies in a sequence, first offset, length."""
    by_length: list[list[tuple]] = [[] for _ in range(capacity + 1)]
    base = 0
    for filling, number in plan:
        offset = 0
        for length in sorted(set(filling), reverse=True):
            copies = filling.count(length)
            by_length[length].append((number * copies, base, copies, offset, length))
            offset += copies * length
        base += number
    rows = [row for slots in reversed(by_length) for row in slots]
    sizes, *rest = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64) for _ in range(5))
    return (np.cumsum(sizes) - sizes, *rest)


def pack_documents(
    documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, key: str = "doc_id", text: str = "text",
    cached_words: int = CACHED_WORDS,
) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document.

    A null text is empty: one piece that holds only ``end_id``. Rows with a null key and
    repeated rows are packed like all others; an empty table gives an empty result.
    ``cached_words`` trades a worker's memory for time.
    """
    return pack_pieces(token_pieces(documents, tokenizer, end_id, capacity, key, text, cached_words), capacity, [key, "piece", "ids_crc32"])
