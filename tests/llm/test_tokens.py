from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import bpe as B, packing as P, token_file as T
from corpusloom.llm.tokens import WordEncoder, read_definition

WORD, BYTE = (read_definition(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
word, byte = Tokenizer.from_str(WORD), Tokenizer.from_str(BYTE)
encoder, codec = WordEncoder(WORD, 50), B.ByteBpe(BYTE, 50)

TEXT = st.lists(
    st.one_of(st.text(max_size=6), st.sampled_from(["  ", "   ", " \n", "\t ", "<|endoftext|>", "<|startoftext|>", "don't", "É", "Σ", "İ", "ﬁ", "́", "\x1c", "\x85", "12", " the"])),
    max_size=8,
).map("".join)


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_words_as_the_library(text):
    assert ids(encoder.encode(text.encode())) == word.encode(text, add_special_tokens=False).ids


def test_words_are_looked_up_once_for_all_their_places():
    """Texts that are encoded together are as if alone, and a word that stands often in them is asked for once."""

    class Asked(dict):
        n = 0

        def get(self, key, default=None):
            Asked.n += 1
            return super().get(key, default)

    own = WordEncoder(WORD)
    texts = ["the cat the cat", "", " \n ", "the " * 500, "É 日本 cat<|endoftext|> the", "don't the"]
    own.newer = Asked()
    found = [ids(x) for x in own.encode_all([t.encode() for t in texts])]
    assert found == [word.encode(t, add_special_tokens=False).ids for t in texts]
    assert 0 < Asked.n < 10
    assert list(own.encode_all([])) == [] and list(own.encode_all([b""])) == [b""]


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_merges_as_the_library(text):
    found = ids(codec.encode(text))
    assert found == byte.encode(text, add_special_tokens=False).ids
    assert codec.decode(found) == byte.decode(found, skip_special_tokens=False) == text


def test_decoding_cut_characters():
    some = byte.encode("日本é", add_special_tokens=False).ids
    for cut in range(len(some)):
        assert codec.decode(some[:cut]) == byte.decode(some[:cut], skip_special_tokens=False)


def test_digests(odd, none):
    rows = B.token_digests(odd, public_tokenizers.path("byte_bpe_50k.json"))
    assert B.token_digests(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    want = sorted(
        ((r.doc_id, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
         for r in odd.collect() for e in [byte.encode(r.text or "", add_special_tokens=False).ids]), key=repr,
    )
    assert sorted(map(tuple, rows.collect()), key=repr) == want


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 32])
def test_packing_of_bits(bits):
    values = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << bits, 777, np.uint64).astype(np.uint32)
    data = T.pack(values, bits)
    assert len(data) == -(-777 * bits // 8)
    assert (T.unpack(data, bits, 0, 777) == values).all() and (T.unpack(data, bits, 70, 9) == values[70:79]).all()
    if bits < 32:
        with pytest.raises(ValueError, match="more than"):
            T.pack(np.array([1 << bits], np.uint32), bits)


def test_token_files(odd, none, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = T.write_token_files(odd, path, 1, 49_408, block_ids=64)
    found = T.read_token_files(manifest).orderBy("start").collect()
    docs = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at = 0
    assert [r.doc_id for r in found] == [d.doc_id for d in docs]
    for r, d in zip(found, docs):
        want = np.array(word.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    first = T.PackedFile(manifest.first()["path"])
    assert first.bits == 16 and sum(len(first.document(i)) for i in reversed(range(first.documents))) == first.ids
    assert T.read_token_files(T.write_token_files(none, path, 1, 49_408)).count() == 0


def plan_counts(plan, capacity):
    counts = np.zeros(capacity + 1, np.int64)
    for filling, number in plan:
        assert sum(filling) <= capacity and number > 0
        for length in filling:
            counts[length] += number
    return counts


def fewest(lengths, capacity):
    """The least number of sequences, by trying all placements."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                place(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bin_completion_is_best_on_small_cases(lengths):
    counts = np.bincount(lengths or [0], minlength=21)
    counts[0] = 0
    plan = P.bin_completion(counts, 20)
    assert (plan_counts(plan, 20) == counts).all()
    assert sum(n for _, n in plan) == fewest(sorted(lengths, reverse=True), 20)


def test_bin_completion_beats_best_fit():
    # best-fit decreasing needs one more sequence here
    counts = np.bincount([4, 4, 5, 5, 5, 5, 6, 6, 6, 6, 4, 4], minlength=16)
    assert sum(n for _, n in P.bin_completion(counts, 15)) == 4
    assert P.lower_bound(counts, 15) == 4


@pytest.mark.parametrize("low, high, pieces, seed", [(150, 400, 4_000, 0), (150, 400, 300, 1), (300, 500, 500, 1), (100, 110, 1_000, 0), (5, 2048, 3_000, 1)])
def test_search_improves_on_best_fit(low, high, pieces, seed):
    """Lengths of which many fit into a sequence: plans at the lower bound or one above it, and better than best fit."""
    rng = np.random.Generator(np.random.PCG64(seed))
    counts = np.bincount(rng.integers(low, high + 1, pieces), minlength=2049)
    plan = P.bin_completion(counts, 2048)
    assert (plan_counts(plan, 2048) == counts).all() and all(sum(f) <= 2048 for f, _ in plan)
    found, simple = (sum(n for _, n in p) for p in (plan, P.best_fit(counts, 2048)))
    assert found < simple and (found <= P.lower_bound(counts, 2048) + 1 or high == 2048)


def test_packed_documents(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = P.pack_documents(odd, path, 0, 128).collect()
    assert P.pack_documents(none, path, 0, 128).count() == 0
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 128
    total = sum(len(word.encode(d.text or "", add_special_tokens=False).ids) + 1 for d in odd.collect())
    assert sum(r.length for r in rows) == total and len(by_sequence) <= -(-total // 128) + 1
