"""Operators whose plans must not grow with what is stored: key checks, pages, posting tables, terminal queues, timers, stream state."""

from __future__ import annotations

import re
import sys
import time
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import DataFrameWriter, functions as F

from corpusloom.functions.text import WHITESPACE, strip_ws
from corpusloom.operators import flow as J, keys as E, postings as P, tables as T
from corpusloom.plans.embedding import digest_embedder
from corpusloom.plans.ingest import Corpus, Settings, ingest
from corpusloom.plans.queries.corpus import as_files, one_line
from corpusloom.sources.schema import column_checks
from corpusloom.streaming import flows as ST

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors do not have the tests


def test_stored_keys_pass_a_bloom_filter_before_any_shuffle(spark, monkeypatch):
    stored = spark.range(20_000).select((F.col("id") * 3).alias("a"), F.col("id").cast("string").alias("b"))
    new = spark.createDataFrame([(3, "1"), (3, "2"), (6, "2"), (6, "2"), (None, "x"), (59_997, "19999")], "a bigint, b string")
    found = {(r.a, r.b): (r.n, r.problem) for r in E.pk_violations(new, ["a", "b"], stored).collect()}
    assert found == {(3, "1"): (1, "exists"), (6, "2"): (2, "duplicate"), (None, "x"): (1, "null"), (59_997, "19999"): (1, "exists")}
    passed = E.possible_matches(stored, new, ["a", "b"])
    assert {tuple(r) for r in passed.collect()} >= {(3, "1"), (6, "2"), (59_997, "19999")} and passed.count() < 200
    plan = E.possible_matches(stored, new, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    stored_side = plan.split("BroadcastHashJoin")[1].split("BroadcastExchange")[0]
    assert "Exchange" not in stored_side and plan.count("HashAggregate") == 2, plan
    checks = E.pk_violations(new, ["a", "b"], stored)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a#" in checks and checks.count("Aggregate") == 2 + 1  # of new rows, twice, and of the filter
    # more keys than the filter has room for, other types, stored keys that repeat, nothing new
    monkeypatch.setattr(E, "BLOOM_BLOCKS", 2)
    many = spark.range(0, 3_000, 2).select((F.col("id") * 3).alias("a"), F.col("id").cast("string").alias("b"))
    assert E.pk_violations(many, ["a", "b"], stored.union(stored)).count() == 1_500
    assert E.pk_violations(new.withColumn("a", F.col("a").cast("int")), ["a"], stored).where("problem = 'exists'").count() == 1
    assert E.pk_violations(new.limit(0), ["a"], stored).count() == 0


def test_any_page_is_read_by_its_places(spark):
    df = spark.range(1_000).select("id", F.when(F.col("id") % 50 > 0, F.col("id") % 7).alias("x")).repartition(5)
    order = [("x", "desc"), ("id", "asc")]
    pages = T.Pages(df, order)
    for number, size in ((1, 10), (7, 13), (99, 10), (100, 10), (101, 10), (3, 400), (2, 0)):
        assert pages.page(number, size).collect() == T.page(df, number, size, order).collect()
    plan = pages.page(99, 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_pos" in plan and "TakeOrdered" not in plan
    with pytest.raises(ValueError):
        pages.page(0, 10)


def test_posting_tables_find_what_a_scan_finds(spark, tmp_path):
    texts = ["The cat and the dog", "the\u00c9clair AND \u00e9clair", "don't and the rest", "a_b the-and", "", None, "and, THE!", "thea nd", "\u65e5\u672c the and"]
    texts += [f"the word w{i} and more" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").repartition(3)
    path = str(tmp_path / "postings")
    P.store_postings(df, "id", "t", path)
    table = P.Postings(spark, path, "id")
    for terms in (["The", "and"], ["don't"], ["\u00e9clair"], ["w7", "the"], ["the-and"], ["no such word"], ["the", "!"], ["-"], ["a_b"], ["\u65e5\u672c"]):
        want = sorted(r.id for r in df.where(T.fts(F.col("t"), terms)).collect())
        assert sorted(r.id for r in table.lookup(df, "t", terms).collect()) == want, terms
    plan = table.keys(["w7", "the"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*slot", plan)) == 2 and plan.index("EqualTo(word,w7)") < plan.index("EqualTo(word,the)")


def test_days_that_ended_before_are_not_read(spark, tmp_path):
    now = datetime(2024, 3, 10, 12)
    rows = [(i, now - timedelta(hours=7 * i), "failure" if i % 3 else "gone") for i in range(60)] + [(99, None, "gone")]
    df = spark.createDataFrame(rows, "id int, ts timestamp, why string")
    path = str(tmp_path / "dead")
    J.dead_letter(df, "why", path, "ts")
    queue = spark.read.schema("id int, ts timestamp, why string, ended_on date").parquet(path)
    kept = J.unexpired(queue, "ts", now, "5 days")
    want = sorted(r.id for r in J.expire(df, "ts", now, "5 days").collect())
    assert sorted(r.id for r in kept.collect()) == want and kept.columns == ["id", "ts", "why"]
    assert "PartitionFilters: [(isnull(ended_on" in kept._jdf.queryExecution().executedPlan().toString()
    dropped = J.drop_expired(spark, path, now, timedelta(days=5))
    assert len(dropped) > 10 and all("ended_on=2024-0" in d for d in dropped)
    left = spark.read.schema("id int, ts timestamp, why string, ended_on date").parquet(path)
    assert sorted(r.id for r in J.unexpired(left, "ts", now, "5 days").collect()) == want and left.count() < 61


def test_early_records_wait_in_state(spark, tmp_path):
    """They are written once per attempt: the retry table gets none of them again, and they come out when they are due."""
    soon = datetime.now() + timedelta(seconds=12)
    rows = [(1, 2, datetime(2024, 1, 1)), (2, 2, soon), (3, 2, None), (4, 2, datetime(2099, 1, 1))]
    source, path = str(tmp_path / "in"), lambda name: str(tmp_path / name)
    spark.createDataFrame(rows, "id int, attempt int, not_before timestamp").write.parquet(source)
    schema = spark.read.parquet(source).schema
    step = lambda df: df.withColumn("status", F.when(F.col("id") == 3, 503).otherwise(200))

    def once():
        stream = spark.readStream.schema(schema).parquet(source)
        ST.retry_stream(stream, step, path("retry"), ST.folder_sink(path("done")), ST.folder_sink(path("ended")), path("check"), key=["id"]).awaitTermination()
        ids = lambda name: sorted(r.id for r in spark.read.parquet(path(name)).collect())
        return ids("done"), ids("retry")

    assert once() == ([1], [3])
    time.sleep(max(0, (soon - datetime.now()).total_seconds()) + 1)
    spark.createDataFrame([(5, 1, None)], schema).write.mode("append").parquet(source)  # a batch, so that timers are looked at
    assert once() == ([1, 2, 5], [3])


def pages_of(content):
    return [content.decode()]


def test_new_files_do_not_look_at_the_corpus(spark, tmp_path, monkeypatch):
    """Batches of unseen files read no index, however many runs there were; seen and failed ones are looked up; restarts add nothing twice."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    corpus, reports, reads = Corpus(spark, str(tmp_path / f"c{uuid.uuid4().hex}")), [], []
    names, failing = Corpus._names, []

    def watched(self):
        reads.append("read")
        return names(self)

    def report(r):
        reports.append({x.file: x.status for x in r.outcomes.collect()})
        if failing:
            raise RuntimeError("the driver died")

    def embed(texts):
        if any("refused" in t for t in texts):
            raise ValueError("refused")
        return digest_embedder(4)(texts)

    def start():
        ST.stream_ingest(spark, str(inbox), pages_of, corpus, embed, Settings(), str(tmp_path / "check"), "txt", report).awaitTermination()

    def put(name, text, folder=inbox):
        (folder / name).write_text(text)

    put("a [1].txt", "first")
    put("b.txt", "refused now")
    start()
    assert reports[-1] == {"a [1].txt": "succeeded", "b.txt": "ingest_failed"}
    monkeypatch.setattr(Corpus, "_names", watched)
    monkeypatch.setattr(Corpus, "add_names", lambda self, run: None)
    put("c.txt", "third")
    failing.append(1)
    with pytest.raises(Exception, match="the driver died"):
        start()
    failing.clear()
    start()  # the batch runs again: what it stored is found among its own runs
    assert reports[-2:] == [{"c.txt": "succeeded"}, {"c.txt": "skipped"}]
    put("d.txt", "fourth")
    start()
    assert reports[-1] == {"d.txt": "succeeded"} and not reads
    monkeypatch.undo()
    assert sorted(r.filename for r in corpus.documents().collect()) == ["a [1].txt", "c.txt", "d.txt"]
    # a file that came before is looked up: stored ones are skipped, one that was refused is tried again
    time.sleep(1.1)
    put("b.txt", "refused now")
    put("a [1].txt", "first")
    start()
    if reports[-1].keys() == {"a [1].txt", "b.txt"}:  # the source takes changed files as new ones
        assert reports[-1] == {"a [1].txt": "skipped", "b.txt": "ingest_failed"}
    # others write to the same corpus: their documents are found
    other = tmp_path / "other"
    other.mkdir()
    put("e.txt", "fifth", other)
    from corpusloom.sources.files import extract_pages, read_documents, scan_files

    ingest(extract_pages(read_documents(scan_files(spark, str(other), "txt")), pages_of), Settings(), corpus, digest_embedder(4))
    put("e.txt", "fifth")
    start()
    assert reports[-1] == {"e.txt": "skipped"}


def test_checks_of_rows(spark):
    from pyspark.sql.types import StructType

    df = spark.createDataFrame([("1", 5), ("x", None), (None, 7)], "a string, b bigint")
    found = {r["column"]: (r.problem, r["rows"], r.nulls, r.failed) for r in column_checks(df, StructType.fromDDL("a int, b bigint, c date")).collect()}
    assert found == {"a": ("type is string", 3, 1, 1), "b": (None, 3, 1, 0), "c": ("missing column", 3, 3, 0)}


def test_chunks_meet_few_documents_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Where documents are few, neither storing chunks nor reading them back moves a text, whatever the threshold of Spark's broadcasts."""
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = [(i, f"{i} " + "words of a text " * 300, "s") for i in range(20)]
    corpus, plans, parquet = Corpus(spark, str(tmp_path / "corpus")), [], DataFrameWriter.parquet

    def recorded(self, path, *args, **kwargs):
        if path == corpus.chunks_path:
            plans.append(plan_of(self._df))
        return parquet(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        ingest(as_files(spark.createDataFrame(rows, "doc_id bigint, text string, source string")), Settings(), corpus, digest_embedder(8))
        plans.append(plan_of(corpus.chunks()))
        assert corpus.chunks().count() == 20 * 4
    finally:
        spark.conf.set(name, before)
    assert len(plans) == 2
    stored, read = plans
    # what is left are joins of rows per document, below the broadcast
    assert stored.index("BroadcastHashJoin") < stored.find("SortMergeJoin") % len(stored) and "SortMergeJoin" not in read


def test_line_ends_and_white_space_at_both_ends(spark):
    texts = [None, "", "x", *WHITESPACE, *(f"{c}a{c}b{c}" for c in WHITESPACE), *(f"é{c}" for c in WHITESPACE), WHITESPACE, f"a\r\nb\n\r{WHITESPACE}é"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", strip_ws(F.col("t")).alias("s"), one_line("t").alias("l"))
    for row in rows.collect():
        assert row["s"] == (None if row["t"] is None else row["t"].strip(WHITESPACE))
        assert row["l"] == (None if row["t"] is None else row["t"].replace("\r", " ").replace("\n", " "))
