"""Exact duplicates, filter audit and centroid clustering against plain versions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import digest_tree as D, filter_audit as A, heap_centroids as K

WHITE = re.compile(r"[\x20\x09-\x0d]+")


# exact duplicates


@given(st.integers(1, 5_000), st.integers(2, 16))
@settings(max_examples=60, deadline=None)
def test_radices(runs, fan_in):
    found = D.radices(runs, fan_in)
    product = int(np.prod(found)) if found else 1
    assert product >= runs and all(2 <= f <= fan_in for f in found)
    assert len(found) == min(n for n in range(20) if fan_in**n >= runs)


def model_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[WHITE.sub(" ", text or "")].append(i)
    return groups


@pytest.mark.parametrize("runs, fan_in, most", [(1, 8, 4096), (7, 2, 4096), (13, 3, 4096), (13, 8, 5)])
def test_exact_duplicates_against_brute_force(spark, runs, fan_in, most):
    rng = np.random.Generator(np.random.PCG64(runs))
    pool = [f"text {i}\n of words" for i in range(60)] + ["", " ", "text 1 \t of words", "a b", "a  b", "a\x0bb", "a b", " a b"]
    rows = [(i, "hot copy" if i % 3 == 0 else pool[int(rng.integers(len(pool)))]) for i in rng.permutation(400).tolist()]
    docs = spark.createDataFrame([*rows, (400, None)], "doc_id bigint, text string").repartition(runs)
    got = D.exact_duplicates(docs, fan_in=fan_in, most_runs=most)
    want = set()
    for text, ids in model_groups([*rows, (400, None)]).items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        want |= {(i, min(ids), len(ids), i == min(ids), digest) for i in ids}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == 401 and set(found) == want


def test_merges_hold_a_group_once_per_run(spark):
    """A hot group is at most one row per run at every level, and one row in the end."""
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    marks = docs.repartition(9).select(
        F.spark_partition_id().alias("slot"), F.xxhash64("text").alias("digest"), F.unhex(F.sha2("text", 256)).alias("proof"),
        F.octet_length("text").alias("bytes"), F.struct(F.lit(False).alias("missing"), F.col("doc_id").alias("id"), F.col("doc_id").alias("row")).alias("least"),
        F.lit(1).cast("bigint").alias("n"),
    )
    runs = D._merged(marks, 9)
    assert runs.groupBy("digest").count().agg(F.max("count")).first()[0] <= 9
    half = D.tree_merge(runs, [3], 9)
    assert half.groupBy("digest").count().agg(F.max("count")).first()[0] <= 3
    top = D.tree_merge(runs, [3, 3], 9)
    assert top.count() == 601 and top.agg(F.max("n"), F.sum("n")).first()[:] == (300, 900)
    # one exchange for the runs and one a round; the merges need no other
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange shufflepartitionidpassthrough") == plan.count("Exchange ") - plan.count("RoundRobin") == 3


def test_exact_duplicates_of_odd_rows(spark, odd, none):
    clash = odd.withColumns({c: F.lit(1) for c in ("keep_id", "kept", "slot", "digest", "carried", "least", "id")})
    rows = D.exact_duplicates(clash).collect()
    assert len(rows) == odd.count() == 15
    by = defaultdict(list)
    for r in rows:
        by[r.text_sha256].append(r)
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert sorted(r.doc_id for r in empty) == [0, 1] and {r.keep_id for r in empty} == {0}
    cats = by[hashlib.sha256(b"The cat sat on the mat.").hexdigest()]
    assert sorted(r.doc_id for r in cats) == [5, 5, 6] and [r.doc_id for r in cats if r.kept] == [5] and cats[0].group_size == 3
    none_id = [r for r in rows if r.doc_id is None]
    assert none_id[0].kept and none_id[0].keep_id is None
    kept = D.without_exact_duplicates(clash)
    assert kept.dtypes == clash.dtypes and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 2, 3, 4, *range(5, 6), *range(7, 13)]
    assert D.exact_duplicates(none).count() == 0 and D.without_exact_duplicates(none).count() == 0
    keyless = spark.createDataFrame([(None, "x"), (None, "x"), (3, " x")], "doc_id bigint, text string")
    assert sorted((r.kept, r.group_size) for r in D.exact_duplicates(keyless).collect()) == [(False, 2), (True, 1), (True, 2)]


def test_exact_duplicates_run_no_python(spark, odd):
    plan = D.exact_duplicates(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# filter audit


def model_audit(rows, labels):
    """``rows`` of (id, text, lang); every order filtered in turn, text by text."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    marked = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", text)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (i is not None and i > first[text])
        marked.append((i, lang or "", fails))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in marked}:
        own = [(i, f) for i, p, f in marked if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [x for x in left if name not in x[1]]
                out[part, order, step] = [
                    len(left), len(gone), sum(name in f for _, f in own) - len(gone), sum(f == name for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
                shapley[part, name] += len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audit_rows(frame):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in A.COUNTS) for r in frame.collect()}


def test_audit_against_brute_force(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    rows = []
    for i in range(150):
        words = [f"w{k}" for k in rng.integers(0, int(rng.choice([30, 100, 4000])), int(rng.choice([20, 199, 200, 260])))]
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        if rng.random() < 0.3:
            words[0] = "#"
        rows.append((i, " ".join(words), str(rng.choice(["en", "de"]))))
    rows += [(i + 150, rows[int(rng.integers(150))][1], str(rng.choice(["en", "de", "fr"]))) for i in range(60)]
    rows += [(300, None, None), (301, "", ""), (302, "  ", "en"), (303, "x" * 40_000, "en"), (None, rows[0][1], "en"), (7, rows[7][1], rows[7][2])]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 220, 2)] + [(4, 1, None), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, row string, part int").repartition(4)
    found = audit_rows(A.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    assert found == model_audit(rows, labels)


def test_audit_of_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    assert audit_rows(A.audit(odd, labels)) == model_audit(rows, [])
    assert A.audit(none, labels).count() == 0
    fine = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300)), "en")], "doc_id bigint, text string, lang string")
    assert {v for v in audit_rows(A.audit(fine, labels)).values()} == {(1, 0, 0, 0, 0, 0, 0)}


# centroid clustering


def model_clusters(rows, clusters, rounds, scale, dims, seed="2"):
    kept = [(i, np.floor(scale * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v is not None and len(v) == dims and None not in v and np.isfinite(v).all()]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v.tolist()) for i, v in kept if i is not None)
    centroids = [np.array(v) for _, v in order[:clusters]]
    x = np.array([v for _, v in kept])

    def assign():
        d = np.array([[((v - c) ** 2).sum() for c in centroids] for v in x])
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        own, _ = assign()
        for j in range(len(centroids)):
            if (own == j).any():
                centroids[j] = x[own == j].sum(axis=0) // (own == j).sum()
    own, distance = assign()
    total = [int(distance[own == j].sum()) for j in range(len(centroids))]
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return sorted(((i, int(j), int(d), total[j], sum(total), shas[j]) for (i, _), j, d in zip(kept, own, distance)), key=repr)


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("clusters, rounds, grid", [(7, 5, 64), (40, 3, 2), (1, 2, 16), (6, 0, 8)])
def test_clusters_against_brute_force(spark, monkeypatch, clusters, rounds, grid):
    """A coarse grid makes ties and empty clusters; small blocks make many heaps."""
    monkeypatch.setattr(K, "BLOCK_BYTES", 16 * 50)
    rng = np.random.Generator(np.random.PCG64(clusters))
    rows = [(i, (rng.integers(-grid, grid, 4) / 8).tolist()) for i in range(300)]
    rows += [(1_000, None), (1_001, [0.5]), (1_002, [0.5, None, 1.0, 1.0]), (1_003, [0.5, float("nan"), 1.0, 1.0]), (1_004, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [rows[3], (None, [0.25, 0.5, 0.75, 1.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, block string").repartition(3)
    found = K.clustered(frame, dims=4, clusters=clusters, rounds=rounds, scale=16)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=repr) == model_clusters(rows, clusters, rounds, 16, 4)


def test_few_and_no_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0]), (2, [3.0, 4.0])]
    found = K.clustered(spark.createDataFrame(rows, schema), dims=2)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=repr) == model_clusters(rows, 40, 5, 256, 2)
    for nothing in ([], [(1, None)], [(None, [1.0, 2.0])]):
        empty = K.clustered(spark.createDataFrame(nothing, schema), dims=2)
        assert empty.count() == 0 and set(empty.columns) == set(COLUMNS)
    with pytest.raises(Exception, match="beyond"):
        K.clustered(spark.createDataFrame([(1, [1e30, 0.0])], schema), dims=2).count()


def test_only_expired_vectors_are_compared(spark):
    """Separate groups settle at once: after the first passes hardly any gap closes."""
    rng = np.random.Generator(np.random.PCG64(1))
    centres = rng.integers(-400, 400, (12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(0, 1, 8)).tolist()) for i in range(1_200)]
    found = K.cluster(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(2), dims=8, clusters=12, rounds=5)
    assert found.scanned[0] == 1_200 and sum(found.scanned[3:]) < 600
    assert found.assigned.count() == 1_200


def test_blocks_meet_their_heaps_without_a_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with K.Tables(spark, 3) as tables:
            frame = spark.createDataFrame([(i, [i, -i]) for i in range(100)], "id bigint, v array<bigint>")
            blocks = tables.write(K._blocks(frame, 2), "vector-blocks")
            model = K.Model([[0, 0], [50, -50]])
            state = tables.write(K._round(blocks, None, model), "heaps")
            plan = K._round(blocks, state, model)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert not [t for t in spark.catalog.listTables() if t.name in tables.names]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@given(st.integers(0, 2**32 - 1))
@settings(max_examples=25, deadline=None)
def test_heaps_never_keep_a_vector_in_a_wrong_cluster(seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    x = rng.integers(-20, 20, (80, 3)).astype(np.int8)
    model = K.Model([v.tolist() for v in x[:6].astype(int)])
    heaps = K.Heaps.new(len(x), 6)
    for _ in range(8):
        change, _ = heaps.rescan(model, x)
        distances = ((x.astype(int)[:, None, :] - np.array(model.centroids)[None]) ** 2).sum(axis=2)
        assert (heaps.own == distances.argmin(axis=1)).all()
        own, keys, places, sizes = heaps.columns()
        assert sorted(np.frombuffer(places, np.int32).tolist()) == list(range(80))
        heaps = K.Heaps(np.frombuffer(own, np.int32).copy(), np.frombuffer(keys), np.frombuffer(places, np.int32), sizes)
        model.move(change.ravel().tolist())
