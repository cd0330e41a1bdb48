from __future__ import annotations

import os
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusloom.plans.queries import corpus as Q
from corpusloom.operators import stats as D
from corpusloom.plans import embedding as H
from corpusloom.operators.search import find_closest
from corpusloom.plans.ingest import Corpus, Settings, code_table, ingest, prepare, run, with_dims
from corpusloom.sources import files as S
from corpusloom.streaming.flows import stream_ingest


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors do not have the tests


def pages_of(content: bytes):
    """Pages between form feeds; a page that says so cannot be read."""
    if content.startswith(b"broken"):
        raise OSError("not a document")

    def page(text):
        def read():
            if text == "bad":
                raise ValueError("no such font")
            return text

        return read

    return [page(t) for t in content.decode().split("\f")]


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "inbox"
    (folder / "sub").mkdir(parents=True)
    files = {
        "b.pdf": "beta", "A.PDF": "alpha\fbad\f" + "x" * 2900, "empty.pdf": "", "blank.pdf": " \f\n", "broken.pdf": "broken",
        "note.txt": "skip me", "sub/deep.pdf": "deep", "_SUCCESS": "", ".hidden.pdf": "",
    }
    for name, text in files.items():
        (folder / name).write_text(text)
    return str(folder)


def test_scan_and_list(spark, inbox):
    names = lambda df: sorted(os.path.basename(r.path) for r in df.select("path").collect())
    assert names(S.scan_files(spark, inbox)) == ["A.PDF", "b.pdf", "blank.pdf", "broken.pdf", "empty.pdf"]
    assert "deep.pdf" in names(S.scan_files(spark, inbox, recursive=True))
    assert names(S.scan_files(spark, f"{inbox}/note.txt")) == ["note.txt"]
    with pytest.raises(Exception, match="does not exist|FileNotFound"):
        S.scan_files(spark, inbox + "/nothing")
    assert names(S.skipped_files(spark, inbox)) == ["note.txt"]
    listing = S.list_files(spark, inbox, depth=None, pattern=r"(?i)\.pdf$")
    assert {r.name: r.depth for r in listing.collect()}["deep.pdf"] == 2
    assert S.list_files(spark, inbox, depth=0).count() == 0
    assert S.list_files(spark, inbox, depth=1).count() == 6
    assert [r.depth for r in S.list_files(spark, f"{inbox}/b.pdf", depth=0).collect()] == [0]
    plan = S.list_files(spark, inbox)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan
    ordered = [r.name for r in S.by_name(S.list_files(spark, inbox), "name").collect()]
    assert ordered == ["A.PDF", "b.pdf", "blank.pdf", "broken.pdf", "empty.pdf", "note.txt"]


def documents(spark, inbox):
    return S.extract_pages(S.read_documents(S.scan_files(spark, inbox)), pages_of)


def test_extract_pages(spark, inbox):
    rows = {r.filename: r for r in documents(spark, inbox).collect()}
    assert rows["A.PDF"].pages == ["alpha", "", "x" * 2900] and rows["A.PDF"].error is None
    assert rows["A.PDF"].warnings == ["page 2 extract failed: no such font"]
    assert rows["empty.pdf"].error == S.NO_TEXT
    assert rows["broken.pdf"].error == "OSError: not a document"
    stat = os.stat(f"{inbox}/b.pdf")
    fp = rows["b.pdf"].fingerprint
    assert fp.file_size == 4 and abs(fp.mtime - stat.st_mtime) < 1e-3
    assert fp.sha256 == "f44e64e75f3948e9f73f8dfa94721c4ce8cbb4f265c4790c702b2d41cfbf2753"


def new_corpus(spark, tmp_path):
    return Corpus(spark, str(tmp_path / f"corpus-{uuid.uuid4().hex}"))


def outcomes(report):
    return {r.file: r.status for r in report.outcomes.collect()}


def test_nothing_parsed_is_no_success(spark, inbox, tmp_path):
    bad = documents(spark, inbox).where("error is not null")
    assert not ingest(bad, Settings(), new_corpus(spark, tmp_path), H.digest_embedder(4)).summary.first().success


def test_codes_follow_two_ingests(spark, tmp_path):
    corpus = new_corpus(spark, tmp_path)
    files = spark.range(40).select(
        F.concat(F.lit("/f/"), "id").alias("source_path"), F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("filename"),
        S.fingerprint(F.lit(3), F.lit(0.5), F.col("id").cast("string")).alias("fingerprint"),
        F.array(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("pages"), F.lit(None).cast("string").alias("error"),
    )
    for part in (files.where("source_path < '/f/2'"), files.where("source_path >= '/f/2'")):
        ingest(part, Settings(skip_existing=True), corpus, H.digest_embedder(8))
    rows = corpus.chunks().orderBy("id").collect()
    assert len(rows) == 40 and corpus.codes().count() == 40
    found = find_closest(corpus.chunks(), "id", "embedding", list(rows[35].embedding), 1, 8, codes=corpus.codes()).first()
    assert found.id == rows[35].id and abs(found.distance) < 1e-6


@pytest.mark.parametrize(
    "mode, want", [("exact", "ffsf"), ("pad_strict", "sssf"), ("fit", "ssss")]
)
def test_dims_fail_their_document_only(spark, mode, want):
    vectors = spark.createDataFrame(
        [(n, [1.0] * n, None) for n in (1, 2, 3, 4)], "n int, embedding array<float>, embed_error string"
    )
    found = with_dims(vectors, 3, mode).orderBy("n").collect()
    assert "".join("f" if r.embed_error else "s" for r in found) == want
    assert all(r.embedding is None or len(r.embedding) == 3 for r in found)


def test_full_ingest_and_again(spark, inbox, tmp_path):
    corpus = new_corpus(spark, tmp_path)
    settings = Settings(skip_existing=True, model="m1", backend="self_hosted", token_count=lambda c: F.length(c))
    report = ingest(documents(spark, inbox), settings, corpus, H.digest_embedder(4))
    assert outcomes(report) == {
        "A.PDF": "succeeded", "b.pdf": "succeeded", "empty.pdf": "parse_failed", "blank.pdf": "parse_failed", "broken.pdf": "parse_failed",
    }
    assert report.summary.first().success
    stored = {r.filename: r for r in corpus.documents().collect()}
    assert (stored["A.PDF"].id, stored["b.pdf"].id) == (1, 2)
    meta = stored["A.PDF"].metadata
    assert (meta.title, meta.page_count, meta.chunk_count, meta.embed_model, meta.embed_dims) == ("A", 3, 4, "m1", 4)
    chunks = corpus.chunks().orderBy("id").collect()
    assert [(c.id, c.document_id, c.chunk_index, c.metadata.page) for c in chunks] == [
        (1, 1, 0, 1), (2, 1, 1, 3), (3, 1, 2, 3), (4, 1, 3, 3), (5, 2, 0, 1),
    ]
    assert [c.token_count for c in chunks] == [len(c.content) for c in chunks]
    assert chunks[4].embedding == pytest.approx(H.digest_embedder(4)(["beta"])[0])
    again = ingest(documents(spark, inbox), settings, corpus, H.digest_embedder(4))
    assert outcomes(again)["b.pdf"] == "skipped" and again.summary.first().success
    assert corpus.documents().count() == 2 and corpus.raw_chunks().count() == 5
    with open(f"{inbox}/b.pdf", "w") as f:
        f.write("changed")
    third = ingest(documents(spark, inbox), settings, corpus, H.digest_embedder(4))
    assert outcomes(third)["b.pdf"] == "succeeded"
    assert {(r.id, r.filename) for r in corpus.documents().collect()} == {(1, "A.PDF"), (2, "b.pdf"), (3, "b.pdf")}
    with pytest.raises(ValueError, match="mix vector spaces"):
        ingest(documents(spark, inbox), Settings(model="m2", backend="self_hosted"), corpus, H.digest_embedder(4))
    with pytest.raises(ValueError, match="policy=fail"):
        ingest(documents(spark, inbox), Settings(skip_existing=True, collision_policy="fail", model="m1", backend="self_hosted"), corpus, H.digest_embedder(4))


def test_failed_document_stores_nothing(spark, inbox, tmp_path):
    corpus = new_corpus(spark, tmp_path)

    def embed(texts):
        if any(t == "beta" for t in texts):
            raise H.ModelError("rejected", status=400)
        return [[1.0, 2.0]] * len(texts)

    report = ingest(documents(spark, inbox), Settings(), corpus, embed)
    assert outcomes(report)["b.pdf"] == "ingest_failed" and outcomes(report)["A.PDF"] == "succeeded"
    assert not report.summary.first().success
    assert [r.filename for r in corpus.documents().collect()] == ["A.PDF"]


class Died(Exception):
    pass


def test_a_run_that_died_leaves_nothing_visible(spark, inbox, tmp_path, monkeypatch):
    """Its chunks are not seen, its ids are not used again, and its names are no reason to skip a file."""
    corpus = new_corpus(spark, tmp_path)
    settings = Settings(skip_existing=True)
    ingest(documents(spark, inbox).where("filename = 'b.pdf'"), settings, corpus, H.digest_embedder(4))
    reserve, path = Corpus.reserve, Corpus.documents_path

    def reserve_then_die(self, *sizes):
        taken = reserve(self, *sizes)
        monkeypatch.setattr(Corpus, "documents_path", property(lambda _: "/nowhere\0"))
        return taken

    with monkeypatch.context():
        monkeypatch.setattr(Corpus, "reserve", reserve_then_die)
        with pytest.raises(Exception):
            ingest(documents(spark, inbox), settings, corpus, H.digest_embedder(4))
        monkeypatch.setattr(Corpus, "documents_path", path)
        monkeypatch.setattr(Corpus, "reserve", reserve)
    assert corpus.raw_chunks().count() == 5 and corpus.chunks().count() == corpus.codes().count() == 1
    again = ingest(documents(spark, inbox), settings, corpus, H.digest_embedder(4))
    assert outcomes(again)["A.PDF"] == "succeeded" and outcomes(again)["b.pdf"] == "skipped"
    assert corpus.documents().agg(F.max("id")).first()[0] == 3
    assert sorted(r.id for r in corpus.chunks().collect()) == [1, 6, 7, 8, 9]
    copy = corpus.compacted(str(tmp_path / "copy"))
    assert copy.raw_chunks().count() == copy.codes().count() == 5
    assert set(outcomes(ingest(documents(spark, inbox), settings, copy, H.digest_embedder(4))).values()) == {"skipped", "parse_failed"}


def test_names_of_a_run_that_died_before_storing_them(spark, inbox, tmp_path, monkeypatch):
    corpus = new_corpus(spark, tmp_path)
    settings = Settings(skip_existing=True)
    add = Corpus.add_names

    def die(self, run):
        raise Died

    monkeypatch.setattr(Corpus, "add_names", die)
    with pytest.raises(Died):
        ingest(documents(spark, inbox), settings, corpus, H.digest_embedder(4))
    monkeypatch.setattr(Corpus, "add_names", add)
    assert outcomes(ingest(documents(spark, inbox), settings, corpus, H.digest_embedder(4)))["b.pdf"] == "skipped"
    corpus.add_names(1)
    corpus.add_names(1)  # twice counts once
    found = outcomes(ingest(documents(spark, inbox), settings, corpus, H.digest_embedder(4)))
    assert found["b.pdf"] == found["A.PDF"] == "skipped"
    index = corpus.index().where("probe = 'name'")
    assert index.count() == 4 and "Exchange" not in index._jdf.queryExecution().executedPlan().toString()


def test_decisions_meet_the_index_without_a_shuffle_of_it(spark, inbox, tmp_path):
    """One read of the index, whose buckets are those of the join; chunks are not read for ids."""
    from corpusloom.operators import dedup

    corpus = new_corpus(spark, tmp_path)
    ingest(documents(spark, inbox), Settings(skip_existing=True), corpus, H.digest_embedder(4))
    new = documents(spark, inbox).select("source_path", "filename", "fingerprint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = corpus.index().join(dedup._probes(new, True), dedup.INDEX_KEY, "left_semi")
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    left = plan.split("Sort [")[1]
    assert plan.count("corpusloom_names_") >= 1 and plan.count("FileScan parquet") == 1
    assert "Exchange" not in left.split("FileScan")[0]


def test_decisions_move_no_page_texts(spark, inbox, tmp_path):
    """Where no file, every file or few files are kept, page texts are not shuffled to meet the decisions."""
    from corpusloom.plans.ingest import prepare

    corpus, settings = new_corpus(spark, tmp_path), Settings(skip_existing=True)
    ingest(documents(spark, inbox), settings, corpus, H.digest_embedder(4))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for changed, want in (([], []), (["b.pdf"], ["b.pdf"]), (["A.PDF", "b.pdf"], ["A.PDF", "b.pdf"])):
            for name in changed:
                with open(f"{inbox}/{name}", "w") as f:
                    f.write(f"changed {changed}")
            prepared = prepare(documents(spark, inbox), settings, corpus, True)
            plan = prepared.chunks._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "hashpartitioning" not in plan
            assert sorted(r.filename for r in prepared.kept.collect()) == want
            assert prepared.outcomes.where("status = 'skipped'").count() == 2 - len(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_chunks_are_not_scanned_for_ids(spark, inbox, tmp_path, monkeypatch):
    """A second run takes its ids from the ranges; of the chunks it reads its own alone."""
    corpus = new_corpus(spark, tmp_path)
    ingest(documents(spark, inbox), Settings(), corpus, H.digest_embedder(4))
    coded = []
    monkeypatch.setattr("corpusloom.plans.ingest.code_table", lambda chunks: coded.append(chunks) or code_table(chunks))
    monkeypatch.setattr(Corpus, "chunks", lambda _: pytest.fail("all chunks were read"))
    ingest(documents(spark, inbox), Settings(), corpus, H.digest_embedder(4))
    assert [r.id for r in coded[0].select("id").orderBy("id").collect()] == [6, 7, 8, 9, 10]
    assert "GreaterThanOrEqual(id,6)" in coded[0]._jdf.queryExecution().executedPlan().toString()
    assert corpus.reserve(3, 7) == (5, 11) and corpus.reserve(1, 1) == (8, 18)


def test_checks_come_before_any_file_is_read(spark, inbox, tmp_path):
    corpus = new_corpus(spark, tmp_path)
    ingest(documents(spark, inbox), Settings(model="m1", backend="self_hosted"), corpus, H.digest_embedder(4))
    opened = spark.sparkContext.accumulator(0)

    def watched(content):
        opened.add(1)
        return pages_of(content)

    files = S.extract_pages(S.read_documents(S.scan_files(spark, inbox)), watched)
    for settings, text in ((Settings(model="m2"), "mix vector spaces"), (Settings(dims_mode="other"), "unknown dims_mode")):
        for mode in ("full", "estimate", "dry_run"):
            with pytest.raises(ValueError, match=text):
                ingest(files, settings, corpus, H.digest_embedder(4), mode)
    spark.range(3).write.parquet(f"{tmp_path}/broken/chunks")
    spark.range(3).write.parquet(f"{tmp_path}/broken/documents")
    with pytest.raises(ValueError, match="missing column"):
        ingest(files, Settings(), Corpus(spark, f"{tmp_path}/broken"), H.digest_embedder(4))
    assert opened.value == 0
    # the corpus's own model and dimension are taken where none are given
    report = ingest(files, Settings(), corpus, H.digest_embedder(6))
    assert opened.value > 0 and set(outcomes(report).values()) == {"ingest_failed", "parse_failed"}
    ingest(files, Settings(), corpus, H.digest_embedder(4))
    assert {r.m for r in corpus.documents().select(F.col("metadata.embed_model").alias("m")).collect()} == {"m1"}


def test_dims_of_the_first_document_and_title_of_a_single_file(spark, inbox, tmp_path):
    def uneven(texts):
        return [[1.0] * (3 if "alpha" in texts else 2) for _ in texts]

    corpus = new_corpus(spark, tmp_path)
    report = ingest(documents(spark, inbox), Settings(title_override="Mine", batch_size=1000), corpus, uneven)
    assert outcomes(report)["A.PDF"] == "succeeded" and outcomes(report)["b.pdf"] == "ingest_failed"
    assert [r.metadata.title for r in corpus.documents().collect()] == ["A"]
    one = new_corpus(spark, tmp_path)
    ingest(documents(spark, inbox).where("filename = 'b.pdf'"), Settings(title_override="Mine"), one, uneven)
    assert [r.metadata.title for r in one.documents().collect()] == ["Mine"]


def test_dry_run_and_estimate(spark, inbox):
    sample = ingest(documents(spark, inbox), Settings(), mode="dry_run").first()
    assert (sample.documents, sample.total_chunks) == (2, 5)
    assert sample.sample_chunk.content == "alpha..."
    cost = ingest(documents(spark, inbox), Settings(), mode="estimate").first()
    assert cost.est_cost_usd == round(cost.total_tokens / 1e6 * 0.13, 6)
    assert ingest(documents(spark, inbox), Settings(backend="openrouter"), mode="estimate").first().est_cost_usd is None
    with pytest.raises(ValueError):
        ingest(documents(spark, inbox), Settings(), mode="other")


def test_stream_ingest(spark, inbox, tmp_path):
    corpus, seen = new_corpus(spark, tmp_path), []
    start = lambda: stream_ingest(
        spark, inbox, pages_of, corpus, H.digest_embedder(4), Settings(), str(tmp_path / "checkpoint"),
        on_report=lambda report: seen.append(outcomes(report)),
    ).awaitTermination()
    start()
    with open(f"{inbox}/c.pdf", "w") as f:
        f.write("gamma")
    start()
    assert sorted(r.filename for r in corpus.documents().collect()) == ["A.PDF", "b.pdf", "c.pdf"]
    assert seen[1] == {"c.pdf": "succeeded"}


def test_calls_stay_inside_a_document(spark):
    sizes = {"a": 7, "b": 1, "c": 3}
    rows = [(doc, i, f"{doc}{i}") for doc, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc string, at int, t string")

    def embed(texts):
        assert len({t[0] for t in texts}) == 1 and [int(t[1:]) for t in texts] == list(range(int(texts[0][1:]), int(texts[0][1:]) + len(texts)))
        return [[float(len(texts))] for _ in texts]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = H.embed_column(df, "t", embed, 3, "doc", "at", tasks=2).collect()
        loose = H.embed_column(df, "t", lambda texts: [[float(len(texts))] for _ in texts], 4, tasks=1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.embed_error is None for r in found) and len(found) == 11
    assert {(r.doc, r.at): r.embedding[0] for r in found} == {
        (doc, i): float(min(3, n - i // 3 * 3)) for doc, n in sizes.items() for i in range(n)
    }
    assert sorted(r.embedding[0] for r in loose) == [3.0] * 3 + [4.0] * 8


def test_pages_and_model_calls_get_bounded_batches(spark):
    """Rows that go to the extractor and to the model come in batches of a few MB, whatever the size of a partition."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(3).select("id", F.lit("text").alias("t"), F.lit(b"page").alias("content"))
    try:
        for step in (lambda: H.embed_column(rows, "t", H.digest_embedder(8)), lambda: S.extract_pages(rows, pages_of)):
            spark.conf.unset(name)  # Spark gives its own value with a unit
            step()
            assert int(spark.conf.get(name)) <= 4 << 20
    finally:
        spark.conf.set(name, before)


def test_model_calls_retry():
    waits, answers = [], [H.ModelError("busy", 429, retry_after=9.0), H.ModelError("net"), [[1.0]]]

    def embed(texts):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert H.call_model(embed, ["x"], waits.append) == [[1.0]]
    assert waits == [9.0, 4.0]
    calls = []

    def always(status, code=None):
        def embed(texts):
            calls.append(1)
            raise H.ModelError("no", status, code)

        return embed

    for status, code, tries in ((503, None, 7), (None, None, 7), (400, None, 1), (429, "insufficient_quota", 1)):
        calls.clear()
        with pytest.raises(H.ModelError):
            H.call_model(always(status, code), ["x"], lambda s: None)
        assert len(calls) == tries
    with pytest.raises(H.ModelError, match="count mismatch 2 vs 1"):
        H.call_model(lambda texts: [[1.0], [2.0]], ["x"])


def test_pin_and_violations(spark):
    docs = spark.createDataFrame([(2, "b", "m2"), (1, "b", "m1")], "id bigint, embed_backend string, embed_model string")
    assert tuple(D.pinned_identity(docs).first()) == ("b", "m1")
    assert [r.id for r in D.space_violations(docs, docs).collect()] == [2]
    unnamed = spark.createDataFrame([(1, "", "m1")], docs.schema)
    assert D.pinned_identity(unnamed).count() == 0 and D.space_violations(docs, unnamed).count() == 0
    assert D.space_violations(docs, docs.limit(0)).count() == 0
    assert D.backend_catalogue(spark).where("batch_size = 64").count() == 7


def test_files_of_bounded_size_from_the_table(spark, tmp_path, monkeypatch):
    """Files come from the table's own partitions: small ones for the stream, several per language for the listing."""
    rows = [(i, f"text number {i} of the table", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    folders = []

    def folder_of(spark, purpose):
        folders.append(str(tmp_path / f"{purpose}-{len(folders)}"))
        return folders[-1]

    monkeypatch.setattr(Q, "work_folder", folder_of)
    monkeypatch.setattr(Q, "FILE_LINES", 7)
    assert sum(r.n for r in Q.streamed_chunks(spark, str(tmp_path)).collect()) == 60
    lines = [len(f.read_text().splitlines()) for f in (tmp_path / "arriving-0").glob("*.txt")]
    assert sum(lines) == 60 and max(lines) <= 7
    assert [tuple(r) for r in Q.listed_files(spark, str(tmp_path)).collect()] == [("en", 2, sum(len(t) + 1 for _, t, _ in rows))]
    assert len([*tmp_path.glob("files-*/lang=en/*.txt")]) == 3
