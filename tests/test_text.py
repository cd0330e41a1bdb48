from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.chunking import chunk_page_rows, chunk_pages, chunk_texts, running_total

TEXTS = [
    "", "   ", "\x1c ", "a", " a b \x85", "　x y\n", "﻿z", "é" * 1600, "b" * 1601, "c" * 2900, "d" * 1401,
    "😀" * 1700, ("word " * 700).strip(), "x" * 1590 + " " * 30 + "y" * 300, "line\n" * 900,
]


def strip_model(text: str) -> str:
    return text.strip()


def chunk_model(text: str, size: int = 1600, step: int = 1400) -> list[str]:
    """Every multiple of the step below the length starts a window, unless one window is enough."""
    text = text.strip()
    count = 1 if len(text) <= size else -(-len(text) // step)
    pieces = (text[n * step :][:size].strip() for n in range(count))
    return [piece for piece in pieces if piece]


def token_model(tokens: list, size: int, overlap: int) -> list[list]:
    """After the first, a window starts only where more than the overlap is left."""
    step = size - overlap
    starts = [s for s in range(0, len(tokens), step) if s == 0 or len(tokens) - s > overlap]
    return [tokens[s : s + size] for s in starts]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_strip_is_python_strip(spark):
    rows = frame(spark, TEXTS).select("id", X.strip_ws(F.col("text")).alias("s")).collect()
    assert {r.id: r.s for r in rows} == {i: strip_model(t) for i, t in enumerate(TEXTS)}


def test_words_are_python_words(spark):
    rows = frame(spark, TEXTS).select("id", X.words(F.col("text")).alias("w")).collect()
    assert {r.id: r.w for r in rows} == {i: t.split() for i, t in enumerate(TEXTS)}


def test_char_chunks_follow_the_loop(spark):
    rows = chunk_texts(frame(spark, TEXTS)).collect()
    found: dict[int, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.id, r.chunk_index)):
        assert row.chunk_index == len(found.setdefault(row.id, []))
        found[row.id].append(row.content)
    assert found == {i: chunk_model(t) for i, t in enumerate(TEXTS) if chunk_model(t)}


def test_window_starts_differ_between_the_two_rules(spark):
    text = spark.range(1).select(F.lit("c" * 2900).alias("t"))
    sizes = text.select(F.transform(X.char_windows(F.col("t")), F.length).alias("n")).first()["n"]
    assert sizes == [1600, 1500, 100]
    tokens = text.select(F.transform(X.token_windows(F.split("t", ""), 1600, 200), F.size).alias("n")).first()["n"]
    assert tokens == [1600, 1500]


def test_token_windows_follow_the_loop(spark):
    sizes = [0, 1, 349, 350, 351, 399, 400, 401, 449, 450, 451, 750, 751, 1100, 5999]
    df = spark.createDataFrame([(n, list(range(n))) for n in sizes], "n int, tokens array<int>")
    for row in df.select("n", X.token_windows(F.col("tokens")).alias("w")).collect():
        assert row.w == token_model(list(range(row.n)), 400, 50), row.n


def test_tokenizer_windows_and_counts(spark):
    split = X.tokenizer_windows(lambda t: [ord(c) for c in t], lambda w: "".join(map(chr, w)), 4, 1)
    count = X.tokenizer_count(lambda t: [ord(c) for c in t])
    df = spark.createDataFrame([("abcdefghij",), ("abcd",), ("",), (None,)], "t string")
    rows = df.select("t", split(F.col("t")).alias("w"), count(F.col("t")).alias("n")).collect()
    found = {r.t: (r.w, r.n) for r in rows}
    assert found["abcdefghij"] == (["abcd", "defg", "ghij"], 10)
    assert found["abcd"] == (["abcd"], 4)
    assert found[""] == ([], 0)
    assert found[None] == ([], None)
    chunks = chunk_texts(df, "t", windows=split)
    assert [r.content for r in chunks.orderBy("chunk_index").collect()].count("abcd") == 2


def test_batches_of_texts_are_bounded(spark, monkeypatch):
    """A worker gets texts in batches of a few MB, whatever the number of rows in its partition."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        sizes = F.pandas_udf(lambda t: t.map(lambda _: int(t.str.len().sum())), "long")
        df = spark.range(3000).select(F.repeat(F.lit("abcdefgh"), 1250).alias("t")).coalesce(1)
        X.tokenizer_count(str.split)
        assert df.select(sizes("t").alias("n")).agg(F.max("n").alias("n")).first()["n"] <= 6 << 20
        spark.conf.set(name, "32m")  # one that is set stays
        X.tokenizer_windows(list, "".join)
        assert spark.conf.get(name) == "32m"
    finally:
        spark.conf.set(name, before)


def test_pages_number_chunks_through_a_document(spark):
    pages = ["first", " ", "c" * 2900, None, "last"]
    wanted = [(0, 1, 5), (1, 3, 1600), (2, 3, 1500), (3, 3, 100), (4, 5, 4)]
    as_array = spark.createDataFrame([("d", pages)], "doc string, pages array<string>")
    rows = chunk_pages(as_array).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.page, len(r.content)) for r in rows] == wanted
    as_rows = spark.createDataFrame([("d", i + 1, p) for i, p in enumerate(pages)], "doc string, page int, text string")
    rows = chunk_page_rows(as_rows, "doc", "page", "text").orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.page, len(r.content)) for r in rows] == wanted


def test_overlaps_restore_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(5003))
    rows = chunk_texts(frame(spark, [text])).orderBy("chunk_index").collect()
    assert rows[0].content + "".join(r.content[200:] for r in rows[1:]) == text


def test_running_total_over_blocks(spark):
    rows = [(key, pos, pos % 3 + 1) for key, n in (("hot", 60), ("cold", 3)) for pos in range(n)]
    df = spark.createDataFrame(rows, "k string, pos int, v int")
    found = running_total(df, ["k"], "pos", "v", "before", block=7).collect()
    for row in found:
        assert row.before == sum(p % 3 + 1 for p in range(row.pos))
    assert len(found) == len(rows)
    whole = running_total(df.where("k = 'hot'"), [], "pos", "v", "before", block=7).collect()
    assert all(r.before == sum(p % 3 + 1 for p in range(r.pos)) for r in whole)


def test_names_and_estimates(spark):
    df = spark.createDataFrame(
        [("a/b/report.final.PDF", "abc"), (".profile", ""), ("plain", "x" * 9), ("x.JS?v=1", "y" * 400)], "name string, body string"
    )
    rows = df.select(
        "name", X.file_stem(X.file_name(F.col("name"))).alias("stem"), X.mime_type(F.col("name")).alias("mime"),
        X.estimate_tokens(F.col("body")).alias("n"), X.preview(F.col("body")).alias("p"),
        X.title(X.file_name(F.col("name")), F.lit("")).alias("title"), X.sanitize_filename(F.col("name")).alias("safe"),
    ).collect()
    assert [r.stem for r in rows] == ["report.final", ".profile", "plain", "x"]
    assert [r.title for r in rows] == [r.stem for r in rows]
    assert [r.mime for r in rows] == ["application/pdf", X.DEFAULT_MIME, X.DEFAULT_MIME, "application/javascript"]
    assert [r.n for r in rows] == [1, 1, 2, 100]
    assert rows[3].p == "y" * 300 + "..." and rows[0].p == "abc..."
    assert rows[0].safe == "a_b_report.final.PDF"
