"""Corpus statistics, embedding and ingest queries over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from corpusloom.operators.stats import (
    batch_totals, cost_estimate, doc_stats, outcome_rows, page_stats, pinned_identity, run_report, space_violations,
    with_catalogue,
)
from corpusloom.operators.tables import linked
from corpusloom.plans.embedding import digest_embedder, embed_column
from corpusloom.plans.ingest import Corpus, Settings, ingest
from corpusloom.plans.queries.common import SQL_CHUNKS, SQL_TOKENS, long, sql_char_pieces, table
from corpusloom.plans.queries.text import document_chunks
from corpusloom.session import materialise, spread, work_folder
from corpusloom.sources.files import extract_pages, fingerprint, list_files, read_documents, scan_files
from corpusloom.sources.schema import column_checks, preflight
from corpusloom.streaming.flows import stream_ingest

MODEL = "text-embedding-3-large"
# documents of one arriving file, which is read as one row
FILE_LINES = 500


def documents_stats(spark: SparkSession, folder: str) -> DataFrame:
    return doc_stats(document_chunks(spark, folder), "doc_id")


def documents_pages(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", F.array("source", "text").alias("pages"))
    sized = page_stats(documents)
    return sized.select("doc_id", long("page_count").alias("page_count"), "total_chars")


def documents_totals(spark: SparkSession, folder: str) -> DataFrame:
    return batch_totals(document_chunks(spark, folder), "doc_id")


def documents_cost(spark: SparkSession, folder: str) -> DataFrame:
    return cost_estimate(batch_totals(document_chunks(spark, folder), "doc_id"), "openai", MODEL)


def cost_by_language(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens per language with the price of a model that depends on the language."""
    tokens = (
        doc_stats(document_chunks(spark, folder), "lang")
        .withColumn("model", F.when(F.col("lang") == "en", MODEL).when(F.col("lang") == "fr", "text-embedding-3-small").otherwise("other"))
    )
    priced = with_catalogue(tokens)
    return priced.select(
        "lang", "model", "tokens", long("native_dims").alias("native_dims"),
        F.round(F.col("tokens") / 1000000.0 * F.col("price_per_1m_usd"), 6).alias("usd"),
    )


def chunk_document_join(spark: SparkSession, folder: str) -> DataFrame:
    chunks = document_chunks(spark, folder).select(F.col("doc_id").alias("document_id"), "chunk_index")
    documents = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    joined = linked(chunks, "document_id", documents, "doc_id")
    return joined.select("doc_id", long("chunk_index").alias("chunk_index"), "source", "n_chars")


def _with_model(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("source") == "src3", "self_hosted").otherwise("openai").alias("embed_backend"),
        F.concat(F.lit("model-"), "lang").alias("embed_model"),
    )


def pinned_model(spark: SparkSession, folder: str) -> DataFrame:
    return pinned_identity(_with_model(table(spark, folder, "documents")))


def model_violations(spark: SparkSession, folder: str) -> DataFrame:
    named = _with_model(table(spark, folder, "documents"))
    return space_violations(named, named)


def _embedded(spark: SparkSession, folder: str) -> DataFrame:
    chunks = document_chunks(spark, folder).select("doc_id", "chunk_index", "content")
    found = embed_column(chunks, "content", digest_embedder(8), 64, "doc_id", "chunk_index")
    return materialise(found, "vectors")


def embedded_chunks(spark: SparkSession, folder: str) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return _embedded(spark, folder).select(
        "doc_id", long("chunk_index").alias("chunk_index"), long(F.size("embedding")).alias("dims"),
        F.get("embedding", F.lit(0)).cast("double").alias("first"), total.alias("total"), "embed_error",
    )


def lines_of(content: bytes) -> list[str]:
    """A page per line."""
    return content.decode("utf-8").split("\n")[:-1]


def one_line(text: str) -> Column:
    """A text with blanks for its line ends; ``translate`` looks up every character."""
    return F.replace(F.replace(F.col(text), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))


def file_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written to text files, scanned as files and read page by page."""
    path = work_folder(spark, "files")
    documents = table(spark, folder, "documents").select("lang", one_line("text").alias("value"))
    documents.write.partitionBy("lang").option("maxRecordsPerFile", 200).text(path)
    read = extract_pages(read_documents(scan_files(spark, path, "txt", recursive=True)), lines_of)
    pages = read.select(
        F.regexp_extract("source_path", "lang=([^/]*)", 1).alias("lang"), "error", F.explode("pages").alias("page")
    )
    return pages.select("lang", "error", long(F.length("page")).alias("chars"), F.md5("page").alias("digest"))


def as_files(documents: DataFrame) -> DataFrame:
    """Documents as extracted one-page files."""
    return documents.select(
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        fingerprint(F.octet_length("text"), F.lit(0.5), F.col("text")).alias("fingerprint"),
        F.array("text").alias("pages"),
        F.when(F.length("text") == 0, "no extractable text").alias("error"),
    )


def ingest_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return ingest(as_files(spread(table(spark, folder, "documents"))), Settings(model=MODEL), mode="estimate")


def words_in(content: Column) -> Column:
    """Stands for a tokenizer: the number of space-separated pieces."""
    return F.size(F.split(content, " "))


def ingest_estimate_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The estimate with counts of a tokenizer instead of lengths."""
    settings = Settings(model=MODEL, token_count=words_in)
    return ingest(as_files(spread(table(spark, folder, "documents"))), settings, mode="estimate")


def uneven_embedder(texts: list[str]) -> list[list[float]]:
    """Vectors of 4 values; of 5 for texts that begin with T."""
    return [[0.5] * (5 if text.startswith("T") else 4) for text in texts]


def ingest_dims(spark: SparkSession, folder: str) -> DataFrame:
    """An ingest whose model gives some vectors of a wrong dimension: only their documents fail."""
    corpus = Corpus(spark, work_folder(spark, "corpus"))
    settings = Settings(dims=4, batch_size=1)
    report = ingest(as_files(spread(table(spark, folder, "documents"))), settings, corpus, uneven_embedder)
    return report.outcomes.select("status", "file", F.when(F.col("status") == "ingest_failed", F.col("detail")).alias("detail"))


def streamed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that arrive as the lines of text files, ingested as a stream: every chunk's digest and how often it is stored."""
    path, corpus = work_folder(spark, "arriving"), Corpus(spark, work_folder(spark, "corpus"))
    lines = table(spark, folder, "documents").where("text <> ''").select(one_line("text").alias("value"))
    lines.write.option("maxRecordsPerFile", FILE_LINES).text(path)
    settings = Settings(skip_existing=True)
    stream_ingest(spark, path, lines_of, corpus, digest_embedder(8), settings, work_folder(spark, "checkpoint"), "txt").awaitTermination()
    return corpus.chunks().groupBy(F.md5("content").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written to one folder per language, listed from the top; lengths are summed over a folder's files."""
    path = work_folder(spark, "files")
    documents = table(spark, folder, "documents").where("text <> ''").select("lang", one_line("text").alias("value"))
    documents.write.partitionBy("lang").text(path)
    found = list_files(spark, path, depth=2, pattern=r"/part-[^/]*\.txt$")
    found = found.select(F.regexp_extract("path", "lang=([^/]*)", 1).alias("lang"), long("depth").alias("depth"), "length")
    return found.groupBy("lang", "depth").agg(long(F.sum("length")).alias("length"))


def preflight_tables(spark: SparkSession, folder: str) -> DataFrame:
    """What an ingest would find: missing tables and columns, wrong types, and per column the rows that do not fit."""
    documents = table(spark, folder, "documents")
    need = StructType.fromDDL("doc_id bigint, text string, lang string, source bigint, n_chars int, page int")
    problems = preflight(spark, {"documents": need, "chunks": StructType.fromDDL("id bigint")}, {"documents": documents.schema})
    checks = column_checks(documents, need).withColumn("table", F.lit("documents"))
    return checks.drop("problem").join(problems.drop("required_type"), ["table", "column"], "full").select(
        "table", "column", "required_type", "problem", "rows", "nulls", "failed"
    )


def ingest_dry_run(spark: SparkSession, folder: str) -> DataFrame:
    report = ingest(as_files(spread(table(spark, folder, "documents"))), Settings(), mode="dry_run")
    return report.select(
        "documents", "total_chunks", "total_tokens", long("sample_chunk.page").alias("sample_page"),
        F.col("sample_chunk.content").alias("sample_content"),
    )


def _ingested(spark: SparkSession, folder: str) -> Corpus:
    corpus = Corpus(spark, work_folder(spark, "corpus"))
    settings = Settings(skip_existing=True)
    ingest(as_files(spread(table(spark, folder, "documents"))), settings, corpus, digest_embedder(8))
    return corpus


def ingest_documents(spark: SparkSession, folder: str) -> DataFrame:
    meta = F.col("metadata")
    return _ingested(spark, folder).documents().select(
        "id", "filename", "source_path", meta["title"].alias("title"), long(meta["page_count"]).alias("page_count"),
        meta["chunk_count"].alias("chunk_count"), meta["embed_model"].alias("embed_model"),
        long(meta["embed_dims"]).alias("embed_dims"), meta["file_size"].alias("file_size"), meta["sha256"].alias("sha256"),
    )


def ingest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _ingested(spark, folder).chunks().select(
        "id", "document_id", long("chunk_index").alias("chunk_index"), long("metadata.page").alias("page"),
        F.md5("content").alias("digest"), F.get("embedding", F.lit(0)).cast("double").alias("first"),
    )


def ingest_again(spark: SparkSession, folder: str) -> DataFrame:
    """Summary of a second ingest of the same files: all are skipped."""
    corpus = _ingested(spark, folder)
    again = ingest(as_files(spread(table(spark, folder, "documents"))), Settings(skip_existing=True), corpus, digest_embedder(8))
    return again.summary


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    documents = table(spark, folder, "documents").select("doc_id", "source")
    status = (
        F.when(F.col("quality").isNull(), "parse_failed").when(F.col("quality") == 0, "skipped")
        .when(F.col("toxic") == 1, "ingest_failed").otherwise("succeeded")
    )
    return documents.join(labels, "doc_id", "left").select(
        status.alias("status"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file"),
        F.col("toxic").cast("string").alias("detail"),
    )


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return run_report(_outcomes(spark, folder))


def run_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return outcome_rows(_outcomes(spark, folder))


_STATS = f"count(*) AS chunk_count, sum({SQL_TOKENS})::BIGINT AS tokens, sum(length(content))::BIGINT AS chars"
_TOTALS = f"count(DISTINCT doc_id) AS documents, count(*) AS total_chunks, sum({SQL_TOKENS})::BIGINT AS total_tokens"
_MODEL_ROWS = """m AS (SELECT doc_id AS id, CASE WHEN source = 'src3' THEN 'self_hosted' ELSE 'openai' END AS embed_backend,
  'model-' || lang AS embed_model FROM documents)"""
_BYTE = "(('0x' || substring(md5(content), {at}, 2))::INT - 127.5)::DOUBLE"
_KEPT = f"""WITH {SQL_CHUNKS}, named AS (SELECT doc_id, doc_id || '.txt' AS filename,
  '/corpus/' || source || '/' || doc_id || '.txt' AS source_path, text FROM documents
  WHERE doc_id IN (SELECT doc_id FROM chunks)),
ids AS (SELECT *, row_number() OVER (ORDER BY filename, source_path) AS id FROM named)"""
_OUT = """o AS (SELECT CASE WHEN quality IS NULL THEN 'parse_failed' WHEN quality = 0 THEN 'skipped' WHEN toxic = 1 THEN 'ingest_failed'
  ELSE 'succeeded' END AS status, source || '/' || d.doc_id AS file, toxic::VARCHAR AS detail
  FROM documents d LEFT JOIN labels USING (doc_id))"""

QUERIES = {
    "doc_stats": (documents_stats, f"WITH {SQL_CHUNKS} SELECT doc_id, {_STATS} FROM chunks GROUP BY doc_id"),
    "page_stats": (
        documents_pages, "SELECT doc_id, 2::BIGINT AS page_count, length(source) + length(text) AS total_chars FROM documents"
    ),
    "batch_totals": (documents_totals, f"WITH {SQL_CHUNKS} SELECT {_TOTALS} FROM chunks"),
    "cost_estimate": (
        documents_cost,
        f"""WITH {SQL_CHUNKS}, t AS (SELECT {_TOTALS} FROM chunks) SELECT *, 'openai' AS backend,
        '{MODEL}' AS model, round(total_tokens / 1000000.0 * 0.13::DOUBLE, 6) AS est_cost_usd FROM t""",
    ),
    "cost_by_language": (
        cost_by_language,
        f"""WITH {SQL_CHUNKS}, t AS (SELECT lang, sum({SQL_TOKENS})::BIGINT AS tokens FROM chunks GROUP BY lang)
        SELECT lang, CASE lang WHEN 'en' THEN '{MODEL}' WHEN 'fr' THEN 'text-embedding-3-small' ELSE 'other' END AS model,
        tokens, CASE lang WHEN 'en' THEN 3072 WHEN 'fr' THEN 1536 END::BIGINT AS native_dims,
        round(tokens / 1000000.0 * CASE lang WHEN 'en' THEN 0.13 WHEN 'fr' THEN 0.02 END::DOUBLE, 6) AS usd FROM t""",
    ),
    "chunk_document_join": (
        chunk_document_join,
        f"WITH {SQL_CHUNKS} SELECT doc_id, chunk_index, d.source, d.n_chars FROM chunks JOIN documents d USING (doc_id)",
    ),
    "pinned_identity": (
        pinned_model,
        f"WITH {_MODEL_ROWS} SELECT embed_backend, embed_model FROM m ORDER BY id LIMIT 1",
    ),
    "space_violations": (
        model_violations,
        f"""WITH {_MODEL_ROWS}, p AS (SELECT embed_backend AS pinned_backend, embed_model AS pinned_model FROM m ORDER BY id LIMIT 1)
        SELECT * FROM m, p WHERE embed_backend <> pinned_backend OR embed_model <> pinned_model""",
    ),
    "embedded_chunks": (
        embedded_chunks,
        f"""WITH {SQL_CHUNKS} SELECT doc_id, chunk_index, 8::BIGINT AS dims, {_BYTE.format(at=1)} AS first,
        {' + '.join(_BYTE.format(at=2 * i + 1) for i in range(8))} AS total, NULL::VARCHAR AS embed_error FROM chunks""",
    ),
    "file_pages": (
        file_pages,
        """WITH p AS (SELECT lang, replace(replace(text, chr(13), ' '), chr(10), ' ') AS page FROM documents)
        SELECT lang, NULL::VARCHAR AS error, length(page) AS chars, md5(page) AS digest FROM p""",
    ),
    "ingest_estimate": (
        ingest_estimate,
        f"""WITH {SQL_CHUNKS}, t AS (SELECT {_TOTALS} FROM chunks) SELECT *, 'openai' AS backend,
        '{MODEL}' AS model, round(total_tokens / 1000000.0 * 0.13::DOUBLE, 6) AS est_cost_usd FROM t""",
    ),
    "ingest_dry_run": (
        ingest_dry_run,
        f"""{_KEPT}, first AS (SELECT content FROM chunks JOIN ids USING (doc_id) ORDER BY id, chunk_index LIMIT 1),
        t AS (SELECT {_TOTALS} FROM chunks)
        SELECT t.*, 1::BIGINT AS sample_page, substring(content, 1, 300) || '...' AS sample_content FROM t, first""",
    ),
    "ingest_documents": (
        ingest_documents,
        f"""{_KEPT}, n AS (SELECT doc_id, count(*) AS chunk_count FROM chunks GROUP BY doc_id)
        SELECT id, filename, source_path, doc_id::VARCHAR AS title, 1::BIGINT AS page_count, chunk_count,
        '{MODEL}' AS embed_model, 8::BIGINT AS embed_dims, strlen(text) AS file_size, sha256(text) AS sha256
        FROM ids JOIN n USING (doc_id)""",
    ),
    "ingest_chunks": (
        ingest_chunks,
        f"""{_KEPT} SELECT row_number() OVER (ORDER BY ids.id, chunk_index) AS id, ids.id AS document_id, chunk_index,
        1::BIGINT AS page, md5(content) AS digest, {_BYTE.format(at=1)} AS first FROM chunks JOIN ids USING (doc_id)""",
    ),
    "ingest_estimate_tokens": (
        ingest_estimate_tokens,
        f"""WITH {SQL_CHUNKS}, t AS (SELECT count(DISTINCT doc_id) AS documents, count(*) AS total_chunks,
        sum(len(string_split(content, ' ')))::BIGINT AS total_tokens FROM chunks) SELECT *, 'openai' AS backend,
        '{MODEL}' AS model, round(total_tokens / 1000000.0 * 0.13::DOUBLE, 6) AS est_cost_usd FROM t""",
    ),
    "ingest_dims": (
        ingest_dims,
        f"""WITH {SQL_CHUNKS}, d AS (SELECT doc_id, bool_or(starts_with(content, 'T')) AS bad FROM chunks GROUP BY doc_id)
        SELECT CASE WHEN d.doc_id IS NULL THEN 'parse_failed' WHEN bad THEN 'ingest_failed' ELSE 'succeeded' END AS status,
        documents.doc_id || '.txt' AS file, CASE WHEN bad THEN 'embedding has 5 dims, expected 4' END AS detail
        FROM documents LEFT JOIN d USING (doc_id)""",
    ),
    "stream_ingest": (
        streamed_chunks,
        "WITH c AS (SELECT unnest(" + sql_char_pieces("translate(text, chr(13) || chr(10), '  ')") + ") AS content FROM documents) "
        "SELECT md5(content) AS digest, count(*) AS n FROM c GROUP BY 1",
    ),
    "list_files": (
        listed_files,
        """SELECT lang, 2::BIGINT AS depth, sum(strlen(translate(text, chr(13) || chr(10), '  ')) + 1)::BIGINT AS length
        FROM documents WHERE text <> '' GROUP BY lang""",
    ),
    "preflight": (
        preflight_tables,
        """SELECT 'documents' AS "table", c AS "column", t AS required_type, p AS problem, (SELECT count(*) FROM documents) AS rows, n AS nulls, f AS failed
        FROM (SELECT 'doc_id' AS c, 'bigint' AS t, NULL AS p, count(*) FILTER (doc_id IS NULL) AS n, 0::BIGINT AS f FROM documents
        UNION ALL SELECT 'text', 'string', NULL, count(*) FILTER (text IS NULL), 0 FROM documents
        UNION ALL SELECT 'lang', 'string', NULL, count(*) FILTER (lang IS NULL), 0 FROM documents
        UNION ALL SELECT 'source', 'bigint', 'type is string', count(*) FILTER (source IS NULL),
          count(*) FILTER (source IS NOT NULL AND TRY_CAST(source AS BIGINT) IS NULL) FROM documents
        UNION ALL SELECT 'n_chars', 'int', 'type is bigint', count(*) FILTER (n_chars IS NULL),
          count(*) FILTER (n_chars IS NOT NULL AND TRY_CAST(n_chars AS INT) IS NULL) FROM documents
        UNION ALL SELECT 'page', 'int', 'missing column', count(*), 0 FROM documents)
        UNION ALL SELECT 'chunks', 'id', NULL, 'missing table', NULL, NULL, NULL""",
    ),
    "ingest_again": (
        ingest_again,
        f"""{_KEPT} SELECT 0::BIGINT AS succeeded, (SELECT count(*) FROM ids) AS skipped,
        (SELECT count(*) FROM documents) - (SELECT count(*) FROM ids) AS parse_failed, 0::BIGINT AS ingest_failed, true AS success""",
    ),
    "run_report": (
        run_summary,
        f"""WITH {_OUT}, c AS (SELECT count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'skipped') AS skipped,
        count(*) FILTER (status = 'parse_failed') AS parse_failed, count(*) FILTER (status = 'ingest_failed') AS ingest_failed FROM o)
        SELECT *, succeeded > 0 AND ingest_failed = 0 AS success FROM c""",
    ),
    "run_outcomes": (run_outcomes, f"WITH {_OUT} SELECT * FROM o"),
}
