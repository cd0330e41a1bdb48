from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import query_waves as W, search as S
from corpusloom.session import materialise

random.seed(7)


def frame(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "id bigint, v array<float>")


def vectors(n, dims, step=None):
    values = [[random.gauss(0, 1) for _ in range(dims)] for _ in range(n)]
    return [[round(x * step) / step for x in v] for v in values] if step else values


def cosine_model(a, b):
    dot, na, nb = sum(x * y for x, y in zip(a, b)), sum(x * x for x in a), sum(y * y for y in b)
    return math.nan if na * nb == 0 else 1 - max(-1.0, min(1.0, dot / math.sqrt(na * nb)))


def bits_model(v):
    return "".join("1" if x > 0 else "0" for x in v)


def closest_model(rows, query, k, factor):
    k, n = max(k or 1, 1), max(k or 1, 1) * max(factor or 1, 1)
    ham = lambda v: sum(a != b for a, b in zip(bits_model(v), bits_model(query)))
    candidates = sorted((i for i, v in rows if v is not None), key=lambda i: (ham(dict(rows)[i]), i))[:n]
    nan_last = lambda d: (math.isnan(d), d)
    return sorted(candidates, key=lambda i: (nan_last(cosine_model(dict(rows)[i], query)), i))[:k]


def test_literal_matches_the_text_form(spark):
    values = [[0.0, -0.0, 4e-8, 0.00390625, 0.01171875, -0.00390625, 0.1, 1.0, -123.4567891], [2.5, 1 / 3]]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, v array<double>")
    rows = df.orderBy("id").select(V.vector_to_literal(F.col("v")).alias("s")).collect()
    assert [r.s for r in rows] == ["[" + ",".join(f"{x:.7f}" for x in v) + "]" for v in values]


def test_literal_round_trip(spark):
    df = frame(spark, vectors(20, 70))
    back = V.literal_to_vector(V.vector_to_literal(F.col("v")), 70)
    worst = df.select(F.array_max(F.zip_with("v", back, lambda a, b: F.abs(a - b))).alias("d")).agg(F.max("d")).first()[0]
    assert worst <= 1.2e-7  # half a unit of the literal plus single precision
    with pytest.raises(Exception, match="expected 71"):
        df.select(V.literal_to_vector(V.vector_to_literal(F.col("v")), 71)).collect()


def test_pad_fit_require(spark):
    df = frame(spark, [[1.0] * 3, [1.0] * 4, [1.0] * 5])
    fitted = [r[0] for r in df.orderBy("id").select(V.fit_vector(F.col("v"), 4)).collect()]
    assert fitted == [[1, 1, 1, 0], [1, 1, 1, 1], [1, 1, 1, 1]]
    twice = df.select((V.fit_vector(V.fit_vector(F.col("v"), 4), 4) == V.fit_vector(F.col("v"), 4)).alias("same"))
    assert all(r.same for r in twice.collect())
    padded = df.where("id < 2").orderBy("id").select(V.pad_vector(F.col("v"), 4)).collect()
    assert [r[0] for r in padded] == [[1, 1, 1, 0], [1, 1, 1, 1]]
    with pytest.raises(Exception, match="embedding has 5 dims, more than the 4-dim column"):
        df.select(V.pad_vector(F.col("v"), 4)).collect()
    with_null = df.unionByName(spark.createDataFrame([(9, None)], df.schema))
    good, bad = V.split_by_dims(with_null, "v", 4)
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.error for r in bad.collect()}[9] == "embedding is missing"
    assert bad.count() == 3


@pytest.mark.parametrize("dims", [5, 63, 64, 65, 130])
def test_codes_and_hamming(spark, dims):
    values = vectors(12, dims) + [[0.0] * dims]
    words = V.code_words(F.col("v"), dims)
    df = frame(spark, values)
    rows = df.orderBy("id").select(V.code_bits(words, dims).alias("bits"), F.array(*words).alias("w")).collect()
    assert [r.bits for r in rows] == [bits_model(v) for v in values]
    assert [r.w for r in rows] == [V.query_words(v) for v in values]
    target = [F.lit(w).cast("bigint") for w in V.query_words(values[0])]
    found = [r[0] for r in df.orderBy("id").select(V.hamming(words, target)).collect()]
    assert found == [sum(a != b for a, b in zip(bits_model(v), bits_model(values[0]))) for v in values]


def test_cosine_of_zero_vector_is_nan_and_last(spark):
    values = vectors(6, 8) + [[0.0] * 8]
    query = V.vector_literal_column(values[0])
    rows = frame(spark, values).select("id", V.cosine_distance(F.col("v"), query).alias("d")).orderBy("d", "id").collect()
    assert rows[-1].id == 6 and math.isnan(rows[-1].d)
    for row in rows[:-1]:
        assert row.d == pytest.approx(cosine_model(values[row.id], values[0]), abs=1e-6)


@pytest.mark.parametrize("k,factor", [(5, 4), (1, 1), (0, 3), (-1, None), (None, 0), (50, 4)])
def test_find_closest(spark, k, factor):
    values = vectors(60, 16, step=2)
    values[7] = values[3]
    rows = [(i, None if i % 17 == 5 else v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>").withColumn("name", F.concat(F.lit("n"), "id"))
    found = S.find_closest(df, "id", "v", values[3], k, factor)
    assert found.columns == ["id", "name", "distance"]
    assert [r.id for r in found.collect()] == closest_model(rows, values[3], k, factor)


def test_find_closest_on_empty_table_and_missing_column(spark):
    empty = spark.createDataFrame([], "id bigint, v array<float>")
    assert S.find_closest(empty, "id", "v", [1.0, 2.0]).collect() == []
    with pytest.raises(ValueError, match="does not exist"):
        S.find_closest(empty, "id", "w", [1.0])


@pytest.mark.parametrize("limit,fragment,block", [(1000, 64 << 20, 1024), (0, 640, 3)])
def test_batch_search_equals_single_searches(spark, monkeypatch, limit, fragment, block):
    monkeypatch.setattr(W, "FRAGMENT_BYTES", fragment)
    monkeypatch.setattr(W, "QUERY_BLOCK", block)
    monkeypatch.setattr(W, "SLICE_ROWS", 7 * block)
    monkeypatch.setattr(W, "WAVE_BYTES", 4 * fragment)
    values = vectors(50, 70, step=2) + [[0.0] * 70]
    rows = [(i, None if i == 20 else v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    queries = df.where("id < 8").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    found = S.find_closest_batch(df, "id", "v", queries, "q", "qv", 70, 4, 3, query_limit=limit)
    by_query: dict[int, list[int]] = {}
    for row in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        by_query.setdefault(row.query_id, []).append(row.row_id)
    assert by_query == {q: closest_model(rows, values[q], 4, 3) for q in range(8)}
    exact = S.exact_knn(df, "id", "v", queries, "q", "qv", 4, query_limit=limit).collect()
    want = {q: closest_model(rows, values[q], 4, 1000) for q in range(8)}
    got = {q: [r.row_id for r in sorted(exact, key=lambda r: r["rank"]) if r.query_id == q] for q in range(8)}
    assert got == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 9), st.sampled_from(["code", "cosine"]))
def test_best_rows_of_a_task(seed, k, kind):
    """Rows that come in parts, with equal vectors and zero vectors, against a sort of all scores."""
    rng = np.random.Generator(np.random.PCG64(seed))
    if kind == "code":
        rows, queries = (rng.integers(-(1 << 63), 1 << 63, (n, 2)) & 0xF00F for n in (60, 7))
        score = lambda r, q: float(sum((int(a) ^ int(b)).bit_count() for a, b in zip(r, q)))
    else:
        rows, queries = (rng.integers(-1, 2, (n, 5)).astype(float) for n in (60, 7))
        score = lambda r, q: W.CosineScore(q[None]).pairs(r[None], np.array([0]), np.array([0]))[0]
    keys = rng.permutation(1_000)[:60]
    best = W.Best(np.arange(7), queries, kind, k)
    for at in range(0, 60, 13):
        best.add(keys[at : at + 13], rows[at : at + 13])
    found = pa.Table.from_batches(best.batches()).to_pylist()
    for q in range(7):
        want = sorted((score(r, queries[q]), int(key)) for r, key in zip(rows, keys))[:k]
        assert [r["row_id"] for r in found if r["query_id"] == q] == [key for _, key in want]


def test_no_exchange_carries_a_vector(spark, monkeypatch):
    """However many waves and fragments: only query, row and score are shuffled."""
    monkeypatch.setattr(W, "WAVE_BYTES", 2_000)
    plans = []
    monkeypatch.setattr(S, "materialise", lambda df, purpose: plans.append(df._jdf.queryExecution().executedPlan().toString()) or materialise(df, purpose))
    df = frame(spark, vectors(90, 12)).repartition(3)
    df = materialise(df, "rows")
    queries = df.where("id < 30").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    S.exact_knn(df, "id", "v", queries, "q", "qv", 3, query_limit=0).collect()
    S.find_closest_batch(df, "id", "v", queries, "q", "qv", 12, 3, 2, query_limit=0).collect()
    assert len(plans) > 6
    for plan in plans:
        assert "CartesianProduct" not in plan and "Join" not in plan
        for line in plan.splitlines():
            if "Exchange" in line:
                assert "query_id" in line


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_stored_codes_close_the_search(spark, tmp_path, spread):
    """Candidates are those of the whole table; where they are near, most folders are not read."""
    rng = np.random.Generator(np.random.PCG64(4))
    centres = np.where(np.arange(64)[None, :] < np.array([4, 12, 20, 28, 36, 44, 52, 60])[:, None], 1.0, -1.0)
    values = [(centres[i % 8] + rng.normal(0, spread, 64)).tolist() for i in range(400)]
    df = frame(spark, values)
    codes = S.store_codes(df, "id", "v", 64, str(tmp_path / "codes"))
    folders = {int(f.name.split("=")[1]) for f in (tmp_path / "codes").glob("bits=*")}
    whole = S.build_codes(df, "id", "v", 64)
    for query in (values[0], values[3], values[7]):
        words = [F.lit(w).cast("bigint") for w in V.query_words(query)]
        for wanted in (1, 20, 400, 1_000):
            want = whole.select(V.hamming([F.col("w0")], words).alias("h"), "id").orderBy("h", "id").limit(wanted).collect()
            found, radii = S.nearest_codes(codes, "id", query, wanted)
            assert found == [r.id for r in want]
            if spread < 0.1 and wanted <= 20:
                own = sum(x > 0 for x in query)
                assert sum(abs(b - own) <= radii[-1] for b in folders) <= 2 < len(folders)
    plan = codes.where("bits between 3 and 5")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bits" in plan
    assert [r.id for r in S.find_closest(df, "id", "v", values[5], 5, 4, codes).collect()] == [r.id for r in S.find_closest(df, "id", "v", values[5], 5, 4).collect()]


def test_recall_grows_with_the_factor(spark):
    df = frame(spark, vectors(300, 32))
    queries = df.where("id < 10").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    exact = S.exact_knn(df, "id", "v", queries, "q", "qv", 5)
    means = [
        S.recall_at_k(S.find_closest_batch(df, "id", "v", queries, "q", "qv", 32, 5, rf), exact).agg(F.avg("recall")).first()[0]
        for rf in (1, 4, 60)
    ]
    assert means == sorted(means) and means[-1] == 1.0


def test_codes_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "codes")
    df = frame(spark, vectors(5, 8))
    assert S.store_codes(df, "id", "v", 8, path).count() == 5
    assert S.store_codes(df, "id", "v", 8, path).count() == 5
    grown = frame(spark, vectors(9, 8))
    assert S.store_codes(grown, "id", "v", 8, path).count() == 9
    assert S.store_codes(df, "id", "v", 8, path).count() == 5  # codes of rows that are gone take no part
    with pytest.raises(ValueError, match="does not exist"):
        S.build_codes(df, "id", "nothing", 8)


def test_mixed_dimensions_are_an_error(spark):
    df = frame(spark, [[1.0, 2.0], [1.0, 2.0, 3.0]])
    with pytest.raises(Exception, match="different vector dimensions"):
        df.select(V.cosine_distance(F.col("v"), V.vector_literal_column([1.0, 2.0]))).collect()
    with pytest.raises(Exception, match="expected 2"):
        S.find_closest(df, "id", "v", [1.0, 2.0])
    queries = df.where("id = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    with pytest.raises(Exception, match="different vector dimensions"):
        S.exact_knn(df.coalesce(1), "id", "v", queries, "q", "qv").collect()
