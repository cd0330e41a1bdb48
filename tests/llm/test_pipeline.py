from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from compare import connect, difference
from corpusloom.llm.queries import QUERIES


def test_all_are_registered():
    names = set(entry_points.queries())
    assert {*QUERIES, "pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_against_sql(spark, folder, name):
    assert difference(QUERIES[name][0](spark, folder), connect(folder), QUERIES[name][1]) is None


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept
        stage(spark, before, folder).write.parquet(str(tmp_path / str(i)))
        kept = spark.read.parquet(str(tmp_path / str(i)))
        if i < 3:
            assert kept.schema == docs.schema
        if name == "quality classifier":
            ids = {r.doc_id for r in kept.collect()}
            wrong = [i for i, quality in labels.items() if (i in ids) != (quality == 1)]
            assert len(wrong) <= 0.1 * len(labels)
        elif name == "SimHash near-dedup":
            assert kept.select("text").distinct().count() == kept.count() < before.count()
        elif name == "secret scans":
            assert kept.count() == before.count() and kept.where("text rlike 'token = \"[0-9a-f]{40}\"'").count() == 0
            assert kept.where("n_chars <> length(text)").count() == 0
    assert kept.select("doc_id").distinct().count() == before.count()
    assert kept.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
