"""Language-model scores by logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import Batches, hold, new_file, open_store, prepare, release, text_bytes
from corpusloom.session import materialise, work_folder

# Contexts: the last 1, 2, 3 and 4 bytes of the text, whatever words they lie in, the last 6 bytes of the word, and all of the word's
ORDERS = (1, 2, 3, 4, 6, None)
RUNNING = 4  # orders up to this go on through the borders of words
PLACE_BITS = 19
PLACES = 1 << PLACE_BITS
INPUTS = len(ORDERS) + 1  # and a constant
BITS = 8
SEEN = (0.5, 1.5, 2.5, 4.5, 8.5, 16.5, 32.5, 64.5, 256.5, 1024.5, 4096.5, 16384.5)
LESS_SEEN = (0.5, 3.5, 31.5, 255.5)
LEVELS, LESS_LEVELS = len(SEEN) + 1, len(LESS_SEEN) + 1
GATES = LEVELS * 2 * LESS_LEVELS * BITS
BUCKETS = 33  # of the refining table, over the logit
PRIOR = 0.05  # of a counter, for either bit
RATE = 0.1
# words of one task that learns, whatever the cluster; of one that counts, at least and at most
LEARN_WORDS, TASK_WORDS, LEAST_TASK_WORDS = 150_000, 500_000, 50_000
# words and bytes that are looked at together, so that equal beginnings are met once; edges of one learning and one scoring step
CHUNK_WORDS, CHUNK_BYTES, STEP_EDGES, SCORE_EDGES = 1 << 15, 3 << 17, 8_192, 32_768
# words broadcast with their counts and scores: the most frequent ones, none longer
COMMON_WORDS, COMMON_BYTES = 200_000, 64
COMMON_EDGES = 400_000  # first bytes of words after what stood before, broadcast with their scores
_FLUSH_WORDS, _MORE_WORDS, _FLUSH_BYTES = 250_000, 1 << 17, 64 << 20
_FLUSH_EDGES = 4_000_000
_GROUP_BYTES = 1 << 20  # of texts that are taken apart together
_C = [np.uint64(c | 1) for c in np.random.Generator(np.random.PCG64(9)).integers(1 << 62, 1 << 63, 2 + len(ORDERS), np.uint64).tolist()]
# the table of earlier words: contexts of two words, each with the word that followed most, by its whole 64-bit mark;
# while contexts are counted, followers are told apart by SHORT_BITS of their marks
MATCH_BITS, CHECK_BITS, SHORT_BITS = 22, 18, 24
FOLLOWED, SHARE = (1.5, 2.5, 4.5, 8.5, 32.5), (0.25, 0.5, 0.75, 0.95)
MATCH_LEVELS = 1 + (len(FOLLOWED) + 1) * (len(SHARE) + 1)
_MATCH_TOKENS = 1 << 20
_MATCH_PARTS = 8  # of the places, counted one after the other, so that what counting needs is a part's
# tables of tasks are merged by blocks of places, each a string of rows
MATCH_BLOCKS = 1 << 11
_BLOCK_PLACES = (1 << MATCH_BITS) // MATCH_BLOCKS
MATCH_ROW = np.dtype([("place", "<i4"), ("check", "<u4"), ("target", "<i8"), ("count", "<i8"), ("total", "<i8")])
END = b"\n"  # stands where a word would begin; words hold no white space


def words_of(text: bytes) -> list[bytes]:
    """The words of a text: A-Z in lower case, runs without ASCII white space."""
    return text.lower().split()


# An edge is one of the first three bytes of a word or end, with the bytes that orders 1 to 4 see before it: three bytes of
# what stood before the word's space, and the word's own. Nine bits a byte, value plus one, 0 where there is none; above them the byte's place.
HEAD = 3
_FIELDS = (45, 36, 27, 18, 9, 0)  # third, second and first byte before the space; the word's first three
_PLACE = 54
_SPACE = 33


def heads_of(tokens: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Of every word or end of some texts, each text closed by its end: the bytes around its beginning, as in an edge."""
    data = np.frombuffer(b"  \n " + b" ".join(tokens) + b"  ", np.uint8)
    first = np.cumsum(sizes + 1) - sizes + 3
    byte = lambda k: data[first + k].astype(np.uint64)
    end, out, none = data[first] == END[0], np.zeros(len(first), np.uint64), np.zeros(len(first), bool)
    for k, shift in zip((-2, -3, -4), _FIELDS[2::-1]):
        value = byte(k)
        none |= value == END[0]  # where the text begins
        out |= np.where(none, 0, value + np.uint64(1)) << np.uint64(shift)
    out |= (byte(0) + np.uint64(1)) << np.uint64(_FIELDS[3])
    out |= np.where(end, 0, byte(1) + np.uint64(1)) << np.uint64(_FIELDS[4])
    return out | np.where(sizes < 2, 0, byte(2) + np.uint64(1)) << np.uint64(_FIELDS[5])


def edges_of(heads: np.ndarray) -> list[np.ndarray]:
    """The edges of heads, by places; 0 where the word has ended before."""
    out = []
    for k in range(HEAD):
        seen = sum(511 << shift for shift in _FIELDS[k : k + 4])
        there = heads >> np.uint64(_FIELDS[3 + k]) & np.uint64(511)
        out.append(np.where(there > 0, heads & np.uint64(seen) | np.uint64(k << _PLACE), 0))
    return out


class Layout:
    """Where the bytes of words lie, each followed by a space (the end by nothing)."""

    def __init__(self, words: list[bytes]):
        parts = [w if w == END else w + b" " for w in words]
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.word = np.repeat(np.arange(len(parts)), self.sizes)
        self.at = np.arange(len(self.data)) - self.first[self.word]


class Steps:
    """Bytes with their contexts. Of words, every byte or the given ones, as if nothing but a space stood before the word; or edges."""

    def __init__(self, words: list[bytes] | Layout, rows: np.ndarray | None = None):
        laid = words if isinstance(words, Layout) else Layout(words)
        rows = np.arange(len(laid.data)) if rows is None else rows
        self.data, at = laid.data[rows], laid.at[rows]
        running, own, packed = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64), []
        for k in range(1, 7):
            before = np.where(at < k, 0, laid.data[np.maximum(rows - k, 0)].astype(np.uint64) + np.uint64(1))
            own |= before << np.uint64(9 * (k - 1))
            if k <= RUNNING:
                before[at == k - 1] = _SPACE
                running = running | before << np.uint64(9 * (k - 1))
                packed.append(running)
        powers = np.full(int(laid.sizes.max(initial=1)), _C[-1], np.uint64)
        powers[0] = 1
        sums = (laid.data.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers)[laid.at]
        sums = np.append(np.uint64(0), np.cumsum(sums))
        self._mark([*packed, own, sums[rows] - sums[rows - at] + at.astype(np.uint64)])

    def _mark(self, packed: list[np.ndarray]) -> None:
        self.contexts = np.stack([(p + factor) * factor for p, factor in zip(packed, _C)])

    @classmethod
    def of(cls, edges: np.ndarray) -> Steps:
        """The bytes of edges."""
        made, edges = cls.__new__(cls), edges.astype(np.uint64)
        place = (edges >> np.uint64(_PLACE)).astype(np.int64)
        third, second, last, *own = (edges >> np.uint64(shift) & np.uint64(511) for shift in _FIELDS)
        space, none = np.full(len(edges), _SPACE, np.uint64), np.zeros(len(edges), np.uint64)
        before = [np.choose(place, x) for x in ((space, own[0], own[1]), (last, space, own[0]), (second, last, space), (third, second, last))]
        running, packed = none, []
        for k, value in enumerate(before):
            running = running | value << np.uint64(9 * k)
            packed.append(running)
        packed.append(np.choose(place, (none, own[0], own[1] | own[0] << np.uint64(9))))
        packed.append(np.choose(place, (none, own[0] + np.uint64(1), own[0] + own[1] * _C[-1] + np.uint64(2))))
        made._mark(packed)
        made.data = (np.choose(place, own) - np.uint64(1)).astype(np.uint8)
        return made

    def take(self, rows: np.ndarray) -> Steps:
        """Some of the bytes."""
        part = Steps.__new__(Steps)
        part.data, part.contexts = self.data[rows], self.contexts[:, rows]
        return part

    def joined(self, other: Steps) -> Steps:
        both = Steps.__new__(Steps)
        both.data, both.contexts = np.append(self.data, other.data), np.concatenate([self.contexts, other.contexts], axis=1)
        return both

    def bit(self, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every byte's bit (0 the highest): places of all contexts with the higher bits, and the bit itself."""
        node = (1 << bit | self.data.astype(np.int64) >> (8 - bit)) if bit else np.ones(len(self.data), np.int64)
        mixed = node.astype(np.uint64) * _C[-2]
        places = ((self.contexts ^ mixed) * _C[-1] >> np.uint64(64 - PLACE_BITS)).astype(np.int64)
        places += np.arange(len(ORDERS))[:, None] * PLACES
        return places, self.data >> (7 - bit) & 1


class Tree:
    """Sorted words behind their first three bytes, as a tree: equal beginnings are one byte, with the counts of all their words."""

    def __init__(self, words: list[bytes]):
        laid = Layout(words)
        at, word, sizes, first = laid.at, laid.word, laid.sizes, laid.first
        # of every word the bytes that it begins with like the word before
        earlier = first[word - 1] + np.minimum(at, sizes[word - 1] - 1)
        equal = (at < sizes[word - 1]) & (laid.data == laid.data[earlier]) & (word > 0)
        shared = np.minimum.reduceat(np.where(equal, sizes[word], at), first) if words else sizes
        inner = np.flatnonzero(at >= HEAD)
        inner = inner[np.argsort(at[inner], kind="stable")]  # by depth, and there by words
        fresh = at[inner] >= shared[word[inner]]
        self.word, self.node = word[inner], np.cumsum(fresh) - 1
        self.steps = Steps(laid, inner[fresh])
        self.words = len(words)

    def counts(self, c: np.ndarray) -> np.ndarray:
        return np.bincount(self.node, c[self.word], len(self.steps.data))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per word, over its bytes."""
        return np.bincount(self.word, values[self.node], self.words)


def _objects(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _coded(tokens: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words among tokens, and of every token the number of its word."""
    found = pa.array(tokens, pa.binary()).dictionary_encode()
    return found.dictionary, found.indices.to_numpy()


def _chunks(batches: Batches) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted words with their counts, edges with theirs, of rows ``word, edge, c``: bounded parts of the batches."""
    words: list[bytes] = []
    counts, edges, size = [], [], 0

    def part() -> tuple:
        order = sorted(range(len(words)), key=words.__getitem__)
        both = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
        return [words[i] for i in order], (np.concatenate(counts) if counts else np.zeros(0, np.int64))[order], *both

    for batch in batches:
        word, edge, c = batch.column(0), batch.column(1), batch.column(2).to_numpy()
        kind = word.is_null().to_numpy(zero_copy_only=False)
        edges.append(np.stack([edge.fill_null(0).to_numpy()[kind], c[kind]]))
        own = _objects(word.drop_null())
        c = c[~kind]
        begin = 0
        for i, w in enumerate(own, 1):
            size += len(w)
            if size >= CHUNK_BYTES or len(words) + i - begin >= CHUNK_WORDS:
                words += own[begin:i]
                counts.append(c[begin:i])
                yield part()
                words, counts, edges, size, begin = [], [], [], 0, i
        words += own[begin:]
        counts.append(c[begin:])
    if words or edges:
        yield part()


_SEEN, _LESS_SEEN = (np.digitize(np.arange(int(x[-1]) + 2), x) for x in (SEEN, LESS_SEEN))  # by whole counts


def _pairs(counts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at places, each pair read once."""
    pairs = counts.view(np.uint64)[:, 0].take(places).view(np.float32)
    return pairs[:, 0::2], pairs[:, 1::2]


def _levels(zero: np.ndarray, one: np.ndarray, bit: int) -> np.ndarray:
    """Gate of the weights: how much the whole-word context has been seen and whether always with
    the same bit, how much the four-byte context has been seen, and the bit's place."""
    most = _SEEN[np.minimum(zero[5] + one[5] + 0.5, len(_SEEN) - 1).astype(np.int32)]
    sure = np.minimum(zero[5], one[5]) < 0.5
    less = _LESS_SEEN[np.minimum(zero[3] + one[3] + 0.5, len(_LESS_SEEN) - 1).astype(np.int32)]
    return ((most * 2 + sure) * LESS_LEVELS + less) * BITS + bit


def _logit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Mixer:
    """Weights per gate, learned online, and the table that refines the mixed probability."""

    def __init__(self, weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        if weights is None:
            # at first the whole-word context leads where it has been seen, the others share the rest
            lead = np.repeat(np.linspace(0, 1, LEVELS), GATES // LEVELS)
            weights = np.zeros((GATES, INPUTS))
            weights[:, :5] = (1 - lead)[:, None] * 0.3
            weights[:, 5] = lead
        self.weights = weights
        self.refined = np.zeros((GATES * BUCKETS, 2)) if refined is None else refined
        self.squares = np.full(GATES, 1e-3)
        self.mass = np.zeros(GATES)

    @staticmethod
    def inputs(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        x = np.log((ones + PRIOR) / (zeros + PRIOR))
        return np.concatenate([x, np.full((1, x.shape[1]), 0.3, x.dtype)])

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("kn,nk->n", x, self.weights[gate]), -12, 12)

    @staticmethod
    def buckets(logit: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = (logit + 12) * ((BUCKETS - 1) / 24)
        low = np.minimum(place.astype(np.int64), BUCKETS - 2)
        return gate * BUCKETS + low, place - low

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        """One step: weights move along the mean error of each gate, the table counts outcomes."""
        logit = self.mix(x, gate)
        error = (bit - _logit(logit)) * weight
        mass = np.bincount(gate, weight, GATES)
        own = np.maximum(mass, 1e-9)
        gradient = np.stack([np.bincount(gate, error * row, GATES) for row in x], axis=1) / own[:, None]
        self.squares += (gradient**2).sum(axis=1)
        self.weights += RATE * gradient / np.sqrt(self.squares)[:, None]
        self.mass += mass
        at, share = self.buckets(logit, gate)
        np.add.at(self.refined, (at + (share >= 0.5), bit), weight)

    def table(self) -> np.ndarray:
        """The refined probability of a one at the centre of every bucket."""
        centre = _logit(np.tile(np.linspace(-12, 12, BUCKETS), GATES))
        return (self.refined[:, 1] + 16 * centre) / (self.refined.sum(axis=1) + 16)

    def probability(self, x: np.ndarray, gate: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """Of a one: the mixed probability averaged with the refined one; ``table`` is made once for many steps."""
        table = self.table() if table is None else table
        logit = self.mix(x, gate)
        mixed = _logit(logit)
        at, share = self.buckets(logit, gate)
        refined = table[at] * (1 - share) + table[at + 1] * share
        return np.clip((mixed + refined) / 2, 1e-7, 1 - 1e-7)


def marks_of(words: list[bytes]) -> np.ndarray:
    """64-bit marks of words; a match is equality of marks."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


END_MARK = marks_of([END])[0]


def match_keys(own: np.ndarray, starts: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of every mark: place and check of the two marks before in its text; ``starts`` are the first marks of texts."""
    one, two = np.ones(len(own), np.uint64), np.ones(len(own), np.uint64)
    one[1:], two[2:] = own[:-1], own[:-2]
    one[starts] = two[starts] = 1
    two[np.minimum(np.add(starts, 1), len(own) - 1)] = 1
    mixed = ((one * _C[0]) ^ ((two + np.uint64(7)) * _C[1])) * _C[2]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _C[3]
    place = mixed >> np.uint64(64 - MATCH_BITS)
    check = mixed >> np.uint64(64 - MATCH_BITS - CHECK_BITS) & np.uint64((1 << CHECK_BITS) - 1)
    return place, check


def match_levels(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """0 for a context that was not seen, else by how often its word followed and how often another one."""
    level = 1 + np.digitize(count, FOLLOWED) * (len(SHARE) + 1) + np.digitize(count / np.maximum(total, 1), SHARE)
    return np.where(count > 0, level, 0)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def _most(begin: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Of every run of rows the one with the highest values, compared one after the other; the last of equal ones."""
    sizes = np.diff(np.append(begin, len(values[0])))
    there = np.ones(len(values[0]), bool)
    for value in values:
        value = np.where(there, value.astype(np.int64), np.iinfo(np.int64).min)
        there &= value == np.repeat(np.maximum.reduceat(value, begin), sizes)
    return np.maximum.reduceat(np.where(there, np.arange(len(there)), -1), begin)


class Matches:
    """A table of fixed size: at each place the context seen most, with the word that followed it most."""

    MOST = (1 << 32) - 1  # words that can be counted

    def __init__(self):
        size = 1 << MATCH_BITS
        # one piece of memory, which goes back as a whole
        data = np.zeros(5 * size, np.uint32)
        self.target = data[: 2 * size].view(np.uint64)
        self.check, self.count, self.total = data[2 * size :].reshape(3, size)

    def add(self, place: np.ndarray, check: np.ndarray, target: np.ndarray) -> None:
        self.add_parts([(place, check, target)])

    def add_parts(self, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Places, checks and targets in some parts, as if they were one."""
        shift = np.uint64(MATCH_BITS) - np.uint64(_MATCH_PARTS.bit_length() - 1)
        for part in range(_MATCH_PARTS):
            rows = [np.flatnonzero(place >> shift == part) for place, _, _ in held]
            if any(map(len, rows)):
                self._add(*(np.concatenate([x[i] for x, i in zip(column, rows)]) for column in zip(*held)))

    def _add(self, place: np.ndarray, check: np.ndarray, target: np.ndarray) -> None:
        short = target >> np.uint64(64 - SHORT_BITS)
        keys = place << np.uint64(CHECK_BITS + SHORT_BITS) | check << np.uint64(SHORT_BITS) | short
        order = np.argsort(keys)
        keys = keys[order]
        begin = _runs(keys)
        keys, first, n = keys[begin], np.minimum.reduceat(order, begin), np.diff(np.append(begin, len(keys)))
        context = keys >> np.uint64(SHORT_BITS)
        # of each context the word that followed most, and how often any did
        begin = _runs(context)
        best, total = _most(begin, n), np.add.reduceat(n, begin)
        # of each place the context seen most
        context, most, target = context[begin], n[best], target[first[best]]
        place = (context >> np.uint64(CHECK_BITS)).astype(np.int64)
        own = _most(_runs(place), total)
        place, target = place[own], target[own]
        most, total = most[own].astype(np.uint32), total[own].astype(np.uint32)
        check = (context[own] & np.uint64((1 << CHECK_BITS) - 1)).astype(np.uint32)
        known = (self.check[place] == check) & (self.count[place] > 0)
        same = known & (self.target[place] == target)
        self.count[place[same]] += most[same]
        self.total[place[known]] += total[known]
        fresh = known & ~same & (most > self.count[place]) | ~known & (total > self.total[place])
        at = place[fresh]
        self.target[at], self.count[at] = target[fresh], most[fresh]
        replaced = fresh & ~known
        self.check[place[replaced]], self.total[place[replaced]] = check[replaced], total[replaced]


def merged_matches(rows: np.ndarray) -> np.ndarray:
    """One row per place, of the rows of several tables: counts of equal contexts and words are added, then the word that followed
    a context most and the context seen most at a place stay."""
    context = rows["place"].astype(np.uint64) << np.uint64(CHECK_BITS) | rows["check"]
    order = np.lexsort((rows["target"], context))
    rows, context = rows[order], context[order]
    begin = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (rows["target"][1:] != rows["target"][:-1])))
    count, total = (np.add.reduceat(rows[c], begin) for c in ("count", "total"))
    rows, context = rows[begin], context[begin]
    begin = _runs(context)
    rows["count"], total = count, np.add.reduceat(total, begin)
    rows = rows[_most(begin, rows["count"], rows["target"])]
    rows["total"] = total
    return rows[_most(_runs(rows["place"]), *(rows[c] for c in ("total", "count", "target", "check")))]


_MATCH_SCHEMA = pa.schema([("block", pa.int32()), ("rows", pa.binary())])


def _block_rows(table: Matches) -> Batches:
    """A table by blocks of its places, as rows of MATCH_ROW."""
    for block in range(MATCH_BLOCKS):
        first = block * _BLOCK_PLACES
        part = first + np.flatnonzero(table.count[first : first + _BLOCK_PLACES])
        if len(part):
            rows = np.empty(len(part), MATCH_ROW)
            rows["place"], rows["target"] = part, table.target[part].view(np.int64)
            rows["check"], rows["count"], rows["total"] = table.check[part], table.count[part], table.total[part]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([rows.tobytes()])], schema=_MATCH_SCHEMA)


def _task_matches(batches: Batches) -> Batches:
    """The contexts of a task's texts; a second table is begun where the first one's counts could overflow."""
    release()
    table, held, size, counted = Matches(), [], 0, 0
    for batch in batches:
        for tokens, sizes in _groups(batch.column(0)):
            if counted + size + len(tokens) > Matches.MOST:
                table.add_parts(held)
                yield from _block_rows(table)
                table, held, size, counted = Matches(), [], 0, 0
            words, code = _coded(tokens)
            own = marks_of(_objects(words))[code]
            starts = np.append(0, np.cumsum(sizes)[:-1])
            held.append((*match_keys(own, starts), own))
            size += len(own)
            if size >= _MATCH_TOKENS:
                table.add_parts(held)
                held, size, counted = [], 0, counted + size
                pa.default_memory_pool().release_unused()
    table.add_parts(held)
    yield from _block_rows(table)


def _match_rows(documents: DataFrame) -> DataFrame:
    """The contexts of all training texts, one table per task, merged: ``block, rows``, rows of MATCH_ROW with the places of a block."""

    def merge(block: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x.as_buffer(), MATCH_ROW) for x in block.column("rows")])
        return pa.Table.from_arrays([block.column("block").slice(0, 1), pa.array([merged_matches(rows).tobytes()])], schema=_MATCH_SCHEMA)

    rows = documents.where("not held_out").select("t")
    parts = rows.rdd.getNumPartitions()
    # fewer and larger tasks see more repetitions before the shuffle
    rows = rows.coalesce(max(documents.sparkSession.sparkContext.defaultParallelism, -(-parts // 8)))
    return rows.mapInArrow(_task_matches, "block int, rows binary").groupBy("block").applyInArrow(merge, "block int, rows binary")


def _write_matches(rows: DataFrame, folder: str) -> tuple[str, np.ndarray]:
    """One file of the whole table, and of each level the share of words that it foretells.

    The shares are those of training words, each foretold by the counts without itself.
    """

    def run(batches: Batches) -> Batches:
        size = 1 << MATCH_BITS
        check, target, level = np.zeros(size, "<u4"), np.zeros(size, "<u8"), np.zeros(size, np.uint8)
        hits, misses = np.zeros(MATCH_LEVELS), np.zeros(MATCH_LEVELS)
        for batch in batches:
            for block in batch.column(1):
                rows = np.frombuffer(block.as_buffer(), MATCH_ROW)
                place, count, total = rows["place"], rows["count"], rows["total"]
                check[place], target[place], level[place] = rows["check"], rows["target"].view("<u8"), match_levels(count, total)
                hits += np.bincount(match_levels(count - 1, total - 1), count, MATCH_LEVELS)
                misses += np.bincount(match_levels(count, total - 1), total - count, MATCH_LEVELS)
        path, out = new_file(folder, ".matches")
        for values in (check, target, level):
            out.write(values.tobytes())
        out.close()
        shares = np.clip((hits + 0.2) / (hits + misses + 2), 1e-4, 0.9999)
        shares[0] = 0
        yield pa.RecordBatch.from_pylist([{"path": path, "shares": shares.tolist()}], pa.schema([("path", pa.string()), ("shares", pa.list_(pa.float64()))]))

    found = materialise(rows.coalesce(1).mapInArrow(run, "path string, shares array<double>"), "matches").first()
    return found["path"], np.array(found["shares"])


def _read_matches(path: str, more: str) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Check, target and level of every place, and the counters in ``more``, kept by the worker."""

    def read() -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        store, inner = open_store(path)
        with store.open_input_file(inner) as file:
            data, size = file.read(), 1 << MATCH_BITS
        table = np.frombuffer(data, "<u4", size), np.frombuffer(data, "<u8", size, 4 * size), np.frombuffer(data, np.uint8, size, 12 * size)
        return table, _counters(more)

    return hold(("matches", path), read)


def _groups(texts: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The words of some texts after each other, each text closed by its end, and the texts' numbers of them."""
    tokens: list[bytes] = []
    sizes, held = [], 0
    for t in texts:
        t = t.as_py()
        words = words_of(t)
        tokens += words
        tokens.append(END)
        sizes.append(len(words) + 1)
        held += len(t)
        if held >= _GROUP_BYTES:
            yield tokens, np.array(sizes)
            tokens, sizes, held = [], [], 0
    if sizes:
        yield tokens, np.array(sizes)


def _lengths(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, tokens), np.int64, len(tokens))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


def _unit_counts(documents: DataFrame) -> DataFrame:
    """``word, edge, c``: occurrences of words and of edges in training texts, 0 for those that only others hold."""
    schema = pa.schema([("word", pa.binary()), ("edge", pa.int64()), ("c", pa.int64())])

    def run(batches: Batches) -> Batches:
        release()
        words, known = [], 0  # distinct words with their counts, of one or more batches
        edges, fresh = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0

        def added(parts: list[pa.Array], c: np.ndarray) -> tuple[pa.Array, np.ndarray]:
            coded = pa.chunked_array(parts, pa.binary()).dictionary_encode().combine_chunks()
            return coded.dictionary, np.bincount(coded.indices.to_numpy(), c, len(coded.dictionary)).astype(np.int64)

        def counted() -> Batches:
            for word, c in words:
                own = pc.not_equal(word, END)
                word, c = word.filter(own), c[own.to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([word, pa.nulls(len(word), pa.int64()), pa.array(c)], schema=schema)

        def firsts() -> Batches:
            for at in range(0, len(edges[0]), 1 << 16):
                keys, n = (x[at : at + (1 << 16)] for x in edges)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys.astype(np.int64)), pa.array(n)], schema=schema)

        for batch in batches:
            parts, learned = [], 0
            for held in (False, True):
                for tokens, _ in _groups(batch.column(1).filter(pc.equal(batch.column(0), held))):
                    lengths = _lengths(tokens)
                    heads, n = np.unique(heads_of(tokens, lengths), return_counts=True)
                    n = n * (not held)
                    for own in edges_of(heads):
                        keys, c = _summed(own[own > 0], n[own > 0])
                        edges = np.append(edges[0], keys), np.append(edges[1], c)
                    parts.append(pa.array(tokens, pa.binary()))
                    learned += 0 if held else len(tokens)
                    if len(edges[0]) > 2 * fresh + (1 << 18):
                        edges = _summed(*edges)
                        fresh = len(edges[0])
                    if fresh > _FLUSH_EDGES:
                        yield from firsts()
                        edges, fresh = (edges[0][:0], edges[1][:0]), 0
            if parts:
                words.append(added(parts, np.arange(sum(map(len, parts))) < learned))
            if sum(len(word) for word, _ in words) > 2 * known + _MORE_WORDS:
                words = [added([word for word, _ in words], np.concatenate([c for _, c in words]))]
                known = len(words[0][0])
            if known > _FLUSH_WORDS or sum(word.nbytes for word, _ in words) > _FLUSH_BYTES:
                yield from counted()
                words, known = [], 0
        yield from counted()
        edges = _summed(*edges)
        yield from firsts()

    found = documents.select("held_out", "t").mapInArrow(run, "word binary, edge bigint, c bigint")
    return found.groupBy("word", "edge").agg(F.sum("c").alias("c"))


def _context_counts(units: DataFrame) -> DataFrame:
    """``cell, n``: how often a bit (cell % 2) followed a context (cell / 2) in training texts.

    Every byte of every occurrence counts, with the bytes that stood before it in its text: the first bytes of
    words as edges, the others with their words.
    """
    schema = pa.schema([("cell", pa.int32()), ("n", pa.float64())])

    def run(batches: Batches) -> Batches:
        release()
        cells = np.zeros(2 * PLACES * len(ORDERS))
        for words, c, edges, n in _chunks(batches):
            tree = Tree(words)
            for steps, weight in ((tree.steps, tree.counts(c)), (Steps.of(edges), n)):
                for at in range(0, len(weight), SCORE_EDGES):
                    part = slice(at, at + SCORE_EDGES)
                    step = steps.take(part)
                    for bit in range(BITS):
                        places, ones = step.bit(bit)
                        for row in places:
                            np.add.at(cells, 2 * row + ones, weight[part])
        for at in range(0, len(cells), 1 << 18):
            part = at + np.flatnonzero(cells[at : at + (1 << 18)])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(cells[part])], schema=schema)

    return units.select("word", "edge", "c").mapInArrow(run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n"))


def _write_counts(cells: DataFrame, folder: str) -> str:
    """One file of all counters, of fixed size whatever the corpus; its path."""

    def run(batches: Batches) -> Batches:
        counts = np.zeros(2 * PLACES * len(ORDERS), np.float32)
        for batch in batches:
            counts[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        path, out = new_file(folder, ".counts")
        out.write(counts.tobytes())
        out.close()
        yield pa.RecordBatch.from_pylist([{"path": path}])

    return materialise(cells.coalesce(1).mapInArrow(run, "path string"), "counts").first()["path"]


def _counters(path: str) -> np.ndarray:
    """The counters; row: place, columns: zeros and ones."""
    store, inner = open_store(path)
    with store.open_input_file(inner) as file:
        return np.frombuffer(file.read(), np.float32).reshape(-1, 2)


def _read_counts(path: str) -> np.ndarray:
    """The counters, kept by the worker."""
    return hold(("counts", path), lambda: _counters(path))


def _trained(units: DataFrame, tasks: int, path: str) -> Mixer:
    """Online learning over all training units, task by task; the tasks' weights are averaged by their mass.

    Every occurrence is predicted from the counts without itself, so that words seen
    once teach how far to trust contexts that were never seen. Which units a task has, and their
    order, is decided by their digests.
    """
    schema = pa.schema([("at", pa.int32()), ("value", pa.float64()), ("mass", pa.float64())])

    def run(batches: Batches) -> Batches:
        counts, mixer = _read_counts(path), Mixer()
        for words, c, edges, n in _chunks(batches):
            tree = Tree(words)
            steps, weights = tree.steps.joined(Steps.of(edges)), np.append(tree.counts(c), n)
            order = np.random.Generator(np.random.PCG64(9)).permutation(len(weights))
            for at in range(0, len(order), STEP_EDGES):
                part = order[at : at + STEP_EDGES]
                step, weight = steps.take(part), weights[part]
                for bit in range(BITS):
                    places, ones = step.bit(bit)
                    zero, one = _pairs(counts, places)
                    zero, one = np.maximum(zero - (1 - ones), 0), np.maximum(one - ones, 0)
                    mixer.learn(mixer.inputs(zero, one), _levels(zero, one, bit), ones, weight)
        mass = np.repeat(mixer.mass, INPUTS)
        values = np.concatenate([mixer.weights.ravel() * mass, mixer.refined.ravel()])
        mass = np.concatenate([mass, np.zeros(mixer.refined.size)])
        at = np.flatnonzero((mass > 0) | (values != 0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(values[at]), pa.array(mass[at])], schema=schema)

    rows = units.select("word", "edge", "c").repartition(tasks, "word", "edge").sortWithinPartitions(F.xxhash64("word", "edge"), "word", "edge")
    learned = rows.mapInArrow(run, "at int, value double, mass double")
    found = learned.groupBy("at").agg(F.sum("value").alias("value"), F.sum("mass").alias("mass")).toPandas()
    mixer, cut = Mixer(), GATES * INPUTS
    values, mass = np.zeros(cut + mixer.refined.size), np.zeros(cut + mixer.refined.size)
    values[found["at"]], mass[found["at"]] = found["value"], found["mass"]
    weights = np.where(mass[:cut] > 0, values[:cut] / np.maximum(mass[:cut], 1e-9), mixer.weights.ravel())
    return Mixer(weights.reshape(GATES, INPUTS), values[cut:].reshape(-1, 2))


def _log10_of(steps: Steps, counts: np.ndarray, mixer: Mixer) -> np.ndarray:
    """log10 of the probability of every byte."""
    out, table = np.zeros(len(steps.data)), mixer.table()
    for at in range(0, len(out), SCORE_EDGES):
        step = steps.take(slice(at, at + SCORE_EDGES))
        for bit in range(BITS):
            places, ones = step.bit(bit)
            zero, one = _pairs(counts, places)
            p = mixer.probability(mixer.inputs(zero, one), _levels(zero, one, bit), table)
            out[at : at + SCORE_EDGES] += np.log10(np.where(ones, p, 1 - p))
    return out


def score_documents(documents: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for every row.

    ``held_out`` is a condition over ``documents``; null counts as false. Texts for
    which it is false are learned from. A text is its words (A-Z in lower case, without
    ASCII white space) and one end. ``base_score`` is the smoothed unigram score,
    ``score`` the model's log10 probability, both over words and end; the bytes of
    ``bits_per_byte`` are those of the words, a space behind each, and the end.

    The model predicts the bits of a text from the bytes before them: the last 1, 2, 3 and 4
    of the text, which may lie in earlier words, the last 6 of the word, and all of the word's.
    From the fourth byte of a word on, none of them reaches before its space, so the model is learned and applied
    per distinct word there, and per distinct bytes around its beginning before, each weighted with its exact
    count over the whole corpus: Spark aggregates both, and no pass of the model repeats for
    what is repeated. Before it stands a match predictor: where the two words before have been seen,
    the word that followed them most gets the share with which such contexts proved
    right, and the bit predictors share the rest. Counters, weights and tables have a fixed
    size. Frequent words are broadcast with their scores, at most COMMON_WORDS; all others
    are joined, and mixed with their matches in the same way.
    Null texts are empty; rows with a null key and repeated rows are kept.
    """
    spark = documents.sparkSession
    prepare(spark)
    rows = documents.select(
        F.col(key).cast("bigint").alias("k"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text_bytes(text).alias("t")
    )
    units = materialise(_unit_counts(rows), "vocabulary")
    ends = rows.where("not held_out").count()
    known = units.where("word is not null").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("c") > 0, 1)).alias("words")
    ).first()
    tokens, words = known["tokens"] + ends, known["words"] + (ends > 0)
    # few tasks, since each gives all counters that it touched; but no idle cores where words are few
    cores = spark.sparkContext.defaultParallelism
    tasks = max(1, known["n"] // TASK_WORDS, min(cores, known["n"] // LEAST_TASK_WORDS))
    learned_from = units.where("c > 0")
    folder = work_folder(spark, "mixing")
    path = _write_counts(materialise(_context_counts(learned_from.coalesce(tasks)), "contexts"), folder)
    mixer = _trained(learned_from, -(-known["n"] // LEARN_WORDS) or 1, path)
    shared = spark.sparkContext.broadcast((mixer.weights, mixer.refined))
    schema = pa.schema([("word", pa.binary()), ("edge", pa.int64()), ("c", pa.int64()), ("score", pa.float64())])

    def scored(batches: Batches) -> Batches:
        counts, mixer = _read_counts(path), Mixer(*shared.value)
        for words, c, edges, n in _chunks(batches):
            tree = Tree(words)
            values = tree.sums(_log10_of(tree.steps, counts, mixer))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(c), pa.array(values)], schema=schema)
            values = _log10_of(Steps.of(edges), counts, mixer)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(edges), pa.binary()), pa.array(edges), pa.array(n), pa.array(values)], schema=schema)

    units = materialise(units.select("word", "edge", "c").mapInArrow(scored, "word binary, edge bigint, c bigint, score double"), "scores")
    # words with the score behind their first three bytes; the end has none
    end_row = spark.range(0, 1, 1, 1).select(F.lit(bytearray(END)).alias("word"), F.lit(ends).cast("bigint").alias("c"), F.lit(0.0).alias("score"))
    vocabulary = units.where("word is not null").select("word", "c", "score").union(end_row)
    share = math.log10(tokens + words + 1)
    vocabulary = vocabulary.withColumn("base", F.log10(F.col("c") + 1) - F.lit(share))
    table = spark.sparkContext.broadcast((_common(vocabulary), _common_edges(units)))
    matches, shares = _write_matches(materialise(_match_rows(rows), "matches"), folder)
    out = _known_part(rows.withColumn("id", F.monotonically_increasing_id()), table, shared, matches, path, shares)
    out = materialise(out, "partial")
    # the same mixture as for common words: the share of the match, and the bit model's part of the rest
    levels, nothing = F.array(*map(F.lit, shares.tolist())), F.lit(0.0)

    def mixed(total: Column, hit: Column) -> Column:
        share = F.get(levels, hit["level"])
        return total + F.log10(share + (1 - share) * F.pow(F.lit(10.0), hit["head"] + F.col("score")))

    foretold = F.aggregate("hits", nothing, mixed)
    rare = out.select("id", F.explode("rare").alias("r")).select("id", "r.*").join(vocabulary, "word").groupBy("id").agg(
        F.sum(F.col("n") * F.col("base")).alias("more_base"), F.sum(F.col("m") * F.col("score") + foretold).alias("more_score"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
    )
    none = F.lit(0.0)
    total = F.col("score") + F.coalesce("more_score", none)
    return out.drop("rare").join(rare, "id", "left").select(
        F.col("k").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", none)).alias("base_score"),
        total.alias("score"), (-total * math.log2(10) / F.col("bytes")).alias("bits_per_byte"),
    )


def _most_frequent(rows: DataFrame, limit: int) -> Column:
    """The condition of the rows with the highest ``c``, by classes, no more than ``limit``."""
    level = F.floor(F.log2(F.col("c") + 1) * 8).cast("int")
    lowest, held = None, 0
    for row in sorted(rows.groupBy(level.alias("l")).count().collect(), key=lambda r: -r["l"]):
        held += row["count"]
        if held > limit:
            break
        lowest = row["l"]
    return (level >= lowest) if lowest is not None else F.lit(False)


def _common_edges(units: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent edges with their scores, no more than COMMON_EDGES, sorted."""
    edges = units.where("edge is not null")
    found = edges.where(_most_frequent(edges, COMMON_EDGES)).select("edge", "score").orderBy("edge").toArrow()
    return found.column("edge").to_numpy().astype(np.uint64), found.column("score").to_numpy()


def _head_scores(heads: np.ndarray, common: tuple[np.ndarray, np.ndarray], counts: np.ndarray, mixer: Mixer) -> np.ndarray:
    """Of every head log10 of the probability of its bytes: by the common edges, where there are any, else by the model."""
    keys, scores = common
    heads, back = np.unique(heads, return_inverse=True)
    out = np.zeros(len(heads))
    for own in edges_of(heads):
        edges, place = np.unique(own, return_inverse=True)
        values = np.zeros(len(edges))
        at = np.minimum(np.searchsorted(keys, edges), max(len(keys) - 1, 0))
        found = keys[at] == edges if len(keys) else np.zeros(len(edges), bool)
        values[found] = scores[at[found]]
        left = np.flatnonzero(~found & (edges > 0))
        if len(left):
            values[left] = _log10_of(Steps.of(edges[left]), counts, mixer)
        out += values[place]
    return out[back]


def _common(vocabulary: DataFrame) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent words, by classes of counts, no more than COMMON_WORDS; and the end."""
    end = F.col("word") == F.lit(bytearray(END))
    short = vocabulary.where((F.octet_length("word") <= COMMON_BYTES) & (F.col("c") > 0))
    kept = _most_frequent(short, COMMON_WORDS)
    found = vocabulary.where((F.octet_length("word") <= COMMON_BYTES) & (F.col("c") > 0) & kept | end).select("word", "c", "base", "score").toArrow()
    index = {word: i for i, word in enumerate(found.column("word").to_pylist())}
    return index, marks_of(list(index)), *(found.column(c).to_numpy() for c in ("c", "base", "score"))


def _known_part(rows: DataFrame, table, model, matches: str, counters: str, shares: np.ndarray) -> DataFrame:
    """Of every document: sums over common words and the end, and over the first bytes of the others, which come with their
    counts: all, those that no match foretold, and for each that one did its level and the score of its first bytes."""
    hit_kind = pa.struct([("level", pa.int32()), ("head", pa.float64())])
    rare_kind = pa.struct([("word", pa.binary()), ("n", pa.int64()), ("m", pa.int64()), ("hits", pa.list_(hit_kind))])
    kinds = [("id", pa.int64()), ("k", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
             ("base", pa.float64()), ("score", pa.float64()), ("bytes", pa.int64()), ("rare", pa.list_(rare_kind))]
    schema = pa.schema(kinds)
    rest = np.log10(1 - shares)

    def listed(offsets: np.ndarray, kind: pa.StructType, *columns: np.ndarray | pa.Array) -> pa.ListArray:
        columns = [pa.array(column, field.type) for column, field in zip(columns, kind)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))

    def run(batches: Batches) -> Batches:
        ((index, marks, counts, base, score), edges), mixer = table.value, Mixer(*model.value)
        (checks, targets, levels), cells = _read_matches(matches, counters)
        for batch in batches:
            begin = 0
            for tokens, sizes in _groups(batch.column(3)):
                n = len(sizes)
                # what a word has is looked up once for all its tokens
                words, code = _coded(tokens)
                names, lengths = _objects(words), pc.binary_length(words).to_numpy().astype(np.int64)[code]
                at = np.fromiter(map(index.get, names, repeat(-1)), np.int64, len(names))
                mark, left = marks[at], np.flatnonzero(at < 0)
                mark[left] = marks_of([names[j] for j in left.tolist()])
                at, mark = at[code], mark[code]
                doc, starts = np.repeat(np.arange(n), sizes), np.append(0, np.cumsum(sizes))
                total = lambda x: np.bincount(doc, x, n)  # noqa: B023, E731
                common = at >= 0
                place, check = match_keys(mark, starts[:-1])
                level = np.where(checks[place] == check, levels[place], 0)
                share = shares[level]
                hit = (targets[place] == mark) & (share > 0)
                head = _head_scores(heads_of(tokens, lengths), edges, cells, mixer)
                own = head + np.where(common, score[at], 0)
                value = rest[level] + own
                foretold = hit & common
                value[foretold] = np.log10(share[foretold] + (1 - share[foretold]) * 10.0 ** own[foretold])
                value[hit & ~common] = 0
                # other words of each document, with those of their tokens that a match foretold
                left = np.flatnonzero(~common)
                key = doc[left] * len(names) + code[left]
                order = np.argsort(key, kind="stable")
                left, key = left[order], key[order]
                ends = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
                first, told = left[ends[:-1]], hit[left]
                hit_ends = np.append(0, np.cumsum(told))[ends]
                hits = listed(hit_ends, hit_kind, level[left][told], head[left][told])
                times = np.diff(ends)
                rare = listed(np.searchsorted(doc[first], np.arange(n + 1)), rare_kind, words.take(pa.array(code[first])), times, times - np.diff(hit_ends), hits)
                sums = (sizes, total(common & (counts[at] > 0)), total(np.where(common, base[at], 0)), total(value), total(lengths + 1) - 1)
                columns = [*(batch.column(c).slice(begin, n) for c in range(3)), *(pa.array(x.astype(f.type.to_pandas_dtype())) for x, f in zip(sums, list(schema)[3:8])), rare]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                begin += n
            pa.default_memory_pool().release_unused()

    return rows.select("id", "k", "held_out", "t").mapInArrow(
        run, "id bigint, k bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, bytes bigint, "
        "rare array<struct<word: binary, n: bigint, m: bigint, hits: array<struct<level: int, head: double>>>>",
    )
