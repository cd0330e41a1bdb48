"""Text, chunking and name queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions.chunking import chunk_page_rows, chunk_pages, chunk_texts
from corpusloom.functions.text import (
    estimate_tokens, file_name, file_stem, mime_type, preview, render_template, replace_text, sanitize_filename,
    strip_ws, title, tokenizer_count, tokenizer_windows, word_windows,
)
from corpusloom.plans.queries.common import SQL_CHUNKS, SQL_TOKENS, SQL_WS, SQL_WS_CLASS, long, sql_char_pieces, table
from corpusloom.session import spread


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all documents by characters, with the document columns."""
    return chunk_texts(spread(table(spark, folder, "documents").select("doc_id", "lang", "source", "text")))


def _shown(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.select(
        key,
        long("chunk_index").alias("chunk_index"),
        long("page").alias("page"),
        long(F.length("content")).alias("chars"),
        F.md5("content").alias("digest"),
    )


def chunk_chars(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(document_chunks(spark, folder), "doc_id")


def chunk_words(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return _shown(chunk_texts(documents, windows=word_windows), "doc_id")


def tokenizer_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens per document with an injected tokenizer, here one that takes words as tokens."""
    count = tokenizer_count(str.split)
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return documents.select("doc_id", long(count(F.col("text"))).alias("tokens"))


def tokenizer_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks by the token rule with an injected tokenizer, here one that takes characters as tokens."""
    windows = tokenizer_windows(lambda text: [ord(c) for c in text], lambda tokens: "".join(map(chr, tokens)), 1600, 200)
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return _shown(chunk_texts(documents, windows=windows), "doc_id")


def chunk_conversation_pages(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), "text")
    return _shown(chunk_page_rows(turns, "conv_id", "page", "text"), "conv_id")


def chunk_multi_page(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(
        "doc_id", F.array("lang", F.lit(" "), "text", "source").alias("pages")
    )
    return _shown(chunk_pages(documents), "doc_id")


def chunk_preview(spark: SparkSession, folder: str) -> DataFrame:
    first = document_chunks(spark, folder).where(F.col("chunk_index") == 0)
    return first.select("doc_id", preview(F.col("content")).alias("preview"))


def chunk_tokens_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return document_chunks(spark, folder).select(
        "doc_id", long("chunk_index").alias("chunk_index"), estimate_tokens(F.col("content")).alias("tokens")
    )


def strip_texts(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.concat(F.lit("\x1c  \n"), F.col("text"), F.lit("　\x85\t"))
    stripped = strip_ws(padded)
    return table(spark, folder, "documents").select(
        "doc_id", long(F.length(stripped)).alias("chars"), F.md5(stripped).alias("digest")
    )


def file_titles(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat("source", F.lit(".v1."), "lang", F.lit(".pdf"))
    override = F.when(F.col("lang") == "en", "Report").when(F.col("lang") == "fr", "")
    return table(spark, folder, "documents").select(
        "doc_id", file_stem(name).alias("stem"), title(name, override).alias("title")
    )


def mime_types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", mime_type(F.col("url")).alias("mime"))


def safe_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", sanitize_filename(F.col("url")).alias("name"), file_name(F.col("url")).alias("last")
    )


def replaced_html(spark: SparkSession, folder: str) -> DataFrame:
    content = replace_text(F.col("html"), "<[^>]*>", " ")
    return table(spark, folder, "pages").select(
        "page_id", long(F.length(content)).alias("chars"), F.md5(content).alias("digest")
    )


def rendered_orders(spark: SparkSession, folder: str) -> DataFrame:
    body = render_template(
        "Order ${key} of customer ${customer} is ${status}.",
        key=F.col("o_orderkey"), customer=F.col("o_custkey"), status=F.nullif(F.col("o_orderstatus"), F.lit("P")),
    )
    return table(spark, folder, "orders").select("o_orderkey", body.alias("body"))


_SHOWN = "chunk_index, {page} AS page, length(content) AS chars, md5(content) AS digest"
_STRIPPED = f"trim(chr(28)||' '||chr(160)||chr(10)||text||chr(12288)||chr(133)||chr(9), {SQL_WS})"
_WORDS = f"list_filter(regexp_split_to_array(text, '{SQL_WS_CLASS}+'), lambda w: w <> '')"
_STEM = "source || '.v1.' || lang"
_PATH = "regexp_replace(url, '[?#].*$', '')"
_EXT = f"lower(regexp_extract({_PATH}, '[^/.]\\.([A-Za-z0-9]+)$', 1))"

QUERIES = {
    "chunk_chars": (chunk_chars, f"WITH {SQL_CHUNKS} SELECT doc_id, {_SHOWN.format(page='1')} FROM chunks"),
    "chunk_words": (
        chunk_words,
        f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        l AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(
          range(0, greatest(len(ws) - 51, 0) + 1, 350), lambda i: array_to_string(ws[i + 1 : i + 400], ' ')) END AS l FROM w),
        chunks AS (SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) - 1 AS chunk_index FROM l)
        SELECT doc_id, {_SHOWN.format(page='1')} FROM chunks""",
    ),
    "tokenizer_counts": (tokenizer_counts, f"SELECT doc_id, len({_WORDS}) AS tokens FROM documents"),
    "tokenizer_chunks": (
        tokenizer_chunks,
        f"""WITH t AS (SELECT doc_id, trim(text, {SQL_WS}) AS t FROM documents),
        p AS (SELECT doc_id, list_filter(list_transform(CASE WHEN length(t) = 0 THEN [] ELSE list_transform(
          range(0, greatest(length(t) - 201, 0) + 1, 1400), lambda i: substring(t, i::INT + 1, 1600)) END,
          lambda c: trim(c, {SQL_WS})), lambda c: c <> '') AS l FROM t),
        chunks AS (SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) - 1 AS chunk_index FROM p)
        SELECT doc_id, {_SHOWN.format(page='1')} FROM chunks""",
    ),
    "chunk_conversation_pages": (
        chunk_conversation_pages,
        f"""WITH p AS (SELECT conv_id, turn + 1 AS page, {sql_char_pieces('text')} AS l FROM conversations),
        u AS (SELECT conv_id, page, unnest(l) AS content, generate_subscripts(l, 1) AS piece FROM p),
        chunks AS (SELECT conv_id, page, content, row_number() OVER (PARTITION BY conv_id ORDER BY page, piece) - 1 AS chunk_index FROM u)
        SELECT conv_id, {_SHOWN.format(page='page')} FROM chunks""",
    ),
    "chunk_multi_page": (
        chunk_multi_page,
        f"""WITH r AS (SELECT doc_id, unnest([lang, ' ', text, source]) AS t, unnest([1, 2, 3, 4]) AS page FROM documents),
        p AS (SELECT doc_id, page, {sql_char_pieces('t')} AS l FROM r),
        u AS (SELECT doc_id, page, unnest(l) AS content, generate_subscripts(l, 1) AS piece FROM p),
        chunks AS (SELECT doc_id, page, content, row_number() OVER (PARTITION BY doc_id ORDER BY page, piece) - 1 AS chunk_index FROM u)
        SELECT doc_id, {_SHOWN.format(page='page')} FROM chunks""",
    ),
    "chunk_preview": (
        chunk_preview,
        f"WITH {SQL_CHUNKS} SELECT doc_id, substring(content, 1, 300) || '...' AS preview FROM chunks WHERE chunk_index = 0",
    ),
    "chunk_tokens_estimate": (
        chunk_tokens_estimate, f"WITH {SQL_CHUNKS} SELECT doc_id, chunk_index, {SQL_TOKENS} AS tokens FROM chunks"
    ),
    "strip_texts": (
        strip_texts,
        f"SELECT doc_id, length({_STRIPPED}) AS chars, md5({_STRIPPED}) AS digest FROM documents",
    ),
    "file_titles": (
        file_titles,
        f"SELECT doc_id, {_STEM} AS stem, CASE WHEN lang = 'en' THEN 'Report' ELSE {_STEM} END AS title FROM documents",
    ),
    "mime_types": (
        mime_types,
        f"SELECT page_id, CASE {_EXT} WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html' WHEN 'pdf' THEN 'application/pdf' "
        f"WHEN 'js' THEN 'application/javascript' WHEN 'css' THEN 'text/css' WHEN 'png' THEN 'image/png' "
        f"WHEN 'jpg' THEN 'image/jpeg' WHEN 'xml' THEN 'application/xml' ELSE 'application/octet-stream' END AS mime FROM pages",
    ),
    "safe_names": (
        safe_names,
        """SELECT page_id, regexp_replace(url, '[/\\\\:*?"<>|]', '_', 'g') AS name,
        string_split(url, '/')[-1] AS last FROM pages""",
    ),
    "replaced_html": (
        replaced_html,
        """SELECT page_id, length(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS chars,
        md5(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS digest FROM pages""",
    ),
    "rendered_orders": (
        rendered_orders,
        """SELECT o_orderkey, 'Order ' || o_orderkey || ' of customer ' || o_custkey || ' is ' ||
        coalesce(nullif(o_orderstatus, 'P'), '') || '.' AS body FROM orders""",
    ),
}
