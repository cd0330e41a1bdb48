from __future__ import annotations

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import components as C, simhash as S


def test_shingles_and_fingerprint():
    h = S.shingle_hashes("A b\tC  d".encode(), 3)
    assert h.tolist() == [xxhash.xxh64_intdigest(t, 42) for t in (b"a b c", b"b c d")]
    assert S.shingle_hashes(b"Just Two", 3).tolist() == [xxhash.xxh64_intdigest(b"just two", 42)]
    assert S.simhash(S.shingle_hashes(b" \n", 3)) == 0
    bits = sum(1 << i for i in range(64) if sum(int(x) >> i & 1 for x in h) * 2 > len(h))
    assert S.simhash(h) & (1 << 64) - 1 == bits


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.sets(st.integers(0, 63), max_size=6), st.integers(0, 9))
def test_ring_keeps_every_pair_within_the_radius(radius, flipped, more):
    ring = S.Pigeonring(radius, min(64, 2 * radius + 1 + more))
    x = sum(1 << b for b in flipped)
    viable = any(
        all(bin(x & chain[n]).count("1") <= ring.budgets[n] for n in range(1, ring.segments + 1)) for chain in ring.chains
    )
    assert viable == (len(flipped) <= radius)


def model_components(links):
    root = {}
    find = lambda v: v if root.setdefault(v, v) == v else find(root[v])
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in list(root)}


def test_components(spark):
    links = [(i, i + 1) for i in range(20, 40)] + [(7, 3), (3, 5), (5, 7), (100, 50), (50, 60), (9, 9)] + [(0, j) for j in range(200, 260)]
    found = {r.id: r.root for r in C.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == model_components([p for p in links if p[0] != p[1]])
    assert C.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_of_hot_and_cold_buckets(spark):
    """A dense cluster (hot buckets), random fingerprints with close partners, and zero."""
    rng = np.random.Generator(np.random.PCG64(3))
    base = [int(v) for v in rng.integers(0, 1 << 64, 30, np.uint64)]
    some = {0, 1, *base, *(b ^ 1 << int(i) ^ 1 << int(j) for b in base for i, j in rng.integers(0, 64, (1, 2)))}
    some |= {base[0] ^ 1 << i for i in range(0, 40)} | {base[0] ^ 7 << i for i in range(40, 60)}
    fps = sorted(some)
    want = model_components([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2])
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    links = S.fingerprint_links(frame, 2)
    got = model_components([(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in links.collect()])
    assert got == want
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in links.collect())


def test_near_duplicates_of_odd_rows(odd, none):
    rows = S.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and S.near_duplicates(none).count() == 0
    by = {r.doc_id: r for r in rows}
    assert {by[i].fp for i in (0, 1, 2)} == {0} and {by[i].component_id for i in (0, 1, 2)} == {0}
    assert by[6].component_id == by[5].component_id == 5 and by[None].component_id is None


def test_near_duplicates_against_brute_force(spark):
    """Random texts with edits: every fingerprint and component is that of a plain search over all pairs."""
    rng = np.random.Generator(np.random.PCG64(5))
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(30):
        base = [words[i] for i in rng.integers(0, 500, 200)]
        texts.append(" ".join(base))
        for n in (0, 1, 1, 2, 6):
            copy = list(base)
            for i in rng.integers(0, 200, n):
                copy[i] = "Changed"
            texts.append(" ".join(copy).upper() if n == 1 else "  ".join(copy))
    rows = list(enumerate(texts))
    rows = [rows[i] for i in rng.permutation(len(rows)).tolist()]
    want_fp = {i: S.simhash(S.shingle_hashes(t.encode(), 3)) & (1 << 64) - 1 for i, t in rows}
    want = model_components([
        (a, b) for a in want_fp for b in want_fp if a < b and (want_fp[a] ^ want_fp[b]).bit_count() <= 2
    ])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == {i: (fp, want.get(i, i)) for i, fp in want_fp.items()}
    assert len(set(c for _, c in got.values())) < len(texts)
    kept = sorted(r.doc_id for r in S.without_near_duplicates(docs).collect())
    assert kept == sorted({c for _, c in got.values()})


def test_one_row_of_each_group_stays(spark, odd, none):
    kept = S.without_near_duplicates(odd.withColumn("row", F.lit("x")).withColumn("document", F.lit(1)))
    assert kept.columns == [*odd.columns, "row", "document"]
    got = kept.collect()
    groups = {r.component_id for r in S.near_duplicates(odd).collect()}
    assert len(got) == len(groups) and {r.doc_id for r in got} == groups
    assert S.without_near_duplicates(none).count() == 0 and S.without_near_duplicates(none).schema == none.schema
    keyless = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "e f g")], "doc_id bigint, text string")
    assert sorted(r.text for r in S.without_near_duplicates(keyless).collect()) == ["a b c d", "e f g"]
