from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup as D

FP = "struct<file_size: bigint, mtime: double, sha256: string>"
NEW_FP = (10, 1_700_000_000.25, "a" * 64)
OLD = {
    "same": (10, 1.0, "a" * 64),
    "other": (10, 1_700_000_000.25, "b" * 64),
    "stat": (10, 1_700_000_000.25 + 0.0009, ""),
    "late": (10, 1_700_000_000.25 + 0.0011, None),
    "bigger": (11, 1_700_000_000.25, None),
    "half": (10, None, None),
    "none": None,
}


def match_model(new, old):
    if old and old[2]:
        return "match_sha" if old[2] == new[2] else "diff_sha"
    if old and old[0] is not None and old[1] is not None:
        return "match_stat" if old[0] == new[0] and abs(old[1] - new[1]) < 1e-3 else "diff_stat"
    return "none"


def decide_model(new, rows, policy):
    if not rows or policy == "ingest":
        return "keep", None
    if policy in ("skip", "fail"):
        return {"skip": "skip", "fail": "abort"}[policy], None
    if new is None:
        return "skip", None
    kinds = [(i, match_model(new, fp)) for i, fp in rows]
    matched = [i for i, kind in kinds if kind.startswith("match")]
    if matched:
        return "skip", min(matched)
    return ("skip" if all(kind == "none" for _, kind in kinds) else "keep"), None


@pytest.mark.parametrize("policy", ["fingerprint", "skip", "fail", "ingest", "unheard-of"])
def test_collision_truth_table(spark, policy):
    cases = [(), *[(a,) for a in OLD], *itertools.permutations(OLD, 2)]
    new, old, want, next_id = [], [], {}, 1
    for n, names in enumerate(cases):
        for with_fp in (True, False):
            name = f"f{n}-{with_fp}.txt"
            rows = []
            for kind in names:
                rows.append((next_id, OLD[kind]))
                old.append((next_id, name, OLD[kind]))
                next_id += 1
            fp = NEW_FP if with_fp else None
            new.append((name, name, fp))
            want[name] = decide_model(fp, rows, policy)
    new_df = spark.createDataFrame(new, f"source_path string, filename string, fingerprint {FP}")
    old_df = spark.createDataFrame(old, f"id bigint, filename string, fingerprint {FP}")
    found = D.collision_decision(new_df, old_df, policy).collect()
    assert {r.filename: (r.decision, r.matched_id) for r in found} == want


def test_match_classes_and_reasons(spark):
    rows = [(name, NEW_FP, fp) for name, fp in OLD.items()]
    df = spark.createDataFrame(rows, f"name string, new {FP}, old {FP}")
    found = df.select(
        "name", D.fingerprint_match(F.col("new"), F.col("old")).alias("kind"), D.match_reason(F.col("new"), F.col("old")).alias("why")
    ).collect()
    assert {r.name: r.kind for r in found} == {name: match_model(NEW_FP, fp) for name, fp in OLD.items()}
    why = {r.name: r.why for r in found}
    assert why["same"] == "sha256 match"
    assert why["other"] == "sha256 differs (db=bbbbbbbbbbbb..., new=aaaaaaaaaaaa...)"
    assert why["stat"] == "size+mtime match"
    assert why["bigger"].startswith("size/mtime differ (db=11/")
    assert why["none"] == "no fingerprint in existing row"


def test_messages(spark):
    new = spark.createDataFrame([("p", "f", NEW_FP)], f"source_path string, filename string, fingerprint {FP}")
    old = spark.createDataFrame([(12, "f", None), (3, "f", None)], f"id bigint, filename string, fingerprint {FP}")
    reason = lambda policy: D.collision_decision(new, old, policy).first().reason
    assert reason("fingerprint") == "filename match (lowest doc_id=3 of 2) has no fingerprint in DB; assuming duplicate"
    assert reason("skip") == "filename match (lowest doc_id=3 of 2), policy=skip"
    assert reason("fail") == "filename match (lowest doc_id=3 of 2); policy=fail"
    assert sorted(r.id for r in D.collision_ids(new, old).collect()) == [3, 12]


def test_one_name_with_many_copies_makes_no_pairs(spark):
    """400 files and 400 stored rows under one name: 400 decisions, each against reduced rows."""
    fp = F.struct(F.lit(5).cast("bigint").alias("file_size"), F.lit(0.5).alias("mtime"), F.sha2((F.col("id") % 3).cast("string"), 256).alias("sha256"))
    rows = spark.range(400).select("id", F.lit("same.txt").alias("filename"), fp.alias("fingerprint"))
    found = D.collision_decision(rows.withColumnRenamed("id", "source_path"), rows).collect()
    assert len(found) == 400 and {r.matched_id for r in found} == {0, 1, 2}


def test_message_of_many_rows_has_the_same_shape(spark):
    new = spark.createDataFrame([("p", "f", NEW_FP)], f"source_path string, filename string, fingerprint {FP}")
    old = spark.range(5_000).select("id", F.lit("f").alias("filename"), F.lit(None).cast(FP).alias("fingerprint"))
    assert D.collision_decision(new, old, "skip").first().reason == "filename match (lowest doc_id=0 of 5000), policy=skip"


def test_stored_rows_are_cut_before_they_are_aggregated(spark):
    new = spark.createDataFrame([("p", "f", NEW_FP)], f"source_path string, filename string, fingerprint {FP}")
    old = spark.range(50).select("id", F.col("id").cast("string").alias("filename"), F.lit(None).cast(FP).alias("fingerprint"))
    plan = D.collision_decision(new, old, "skip")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [filename") < plan.rindex("LeftSemi") and plan.count("Range") == 1


def test_an_index_of_parts_decides_like_the_rows(spark):
    """Indexes of two parts put together, read once, against the decisions over all rows."""
    fp = F.when(F.col("id") % 7 > 0, F.struct(
        (F.col("id") % 4).alias("file_size"), (F.col("id") % 9 / 2000).alias("mtime"),
        F.when(F.col("id") % 3 == 0, F.sha2((F.col("id") % 5).cast("string"), 256)).otherwise("").alias("sha256"),
    ))
    rows = spark.range(300).select("id", F.concat(F.lit("n"), (F.col("id") % 11).cast("string")).alias("filename"), fp.alias("fingerprint"))
    new = rows.withColumnRenamed("id", "source_path")
    old = rows.where("id % 2 = 0").withColumn("fingerprint", F.col("fingerprint").cast(FP))
    index = D.name_index(old.where("id < 150")).union(D.name_index(old.where("id >= 150")))
    for policy in ("fingerprint", "skip"):
        want = sorted(map(tuple, D.collision_decision(new, old, policy).collect()))
        assert sorted(map(tuple, D.collision_decision(new, index, policy).collect())) == want and {r[2] for r in want} >= {"skip"}


def test_a_name_of_many_rows_is_spread_by_its_digests(spark):
    old = spark.range(2_000).select("id", F.lit("same.txt").alias("filename"), F.struct(
        F.lit(1).cast("bigint").alias("file_size"), F.lit(0.5).alias("mtime"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"),
    ).alias("fingerprint"))
    index = D.name_index(old)
    assert index.count() == 2_001
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "probe" in plan.split("hashpartitioning(")[1][:60]  # of name, probe and time


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "x")], "id bigint, t string")
    groups = D.duplicate_groups(df, "id", F.sha2("t", 256)).collect()
    assert [(g.n, g.first_id) for g in groups] == [(3, 1)]
    assert sorted(r.id for r in D.duplicate_members(df, "id", F.sha2("t", 256)).collect()) == [1, 3, 4]
