"""Corpus statistics, cost, the model catalogue and the one-model rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.text import estimate_tokens
from corpusloom.operators.tables import earliest_by

# Back ends with their default model, its native size, inputs per
# call and response shape (a size of None is not known beforehand).
BACKENDS = [
    ("self_hosted", None, None, 1, "single"),
    ("openai", "text-embedding-3-large", 3072, 64, "openai"),
    ("openrouter", "openai/text-embedding-3-large", 3072, 64, "openai"),
    ("copilot", "text-embedding-3-small", 1536, 16, "openai"),
    ("google", "gemini-embedding-001", 3072, 64, "openai"),
    ("zai", "embedding-3", 2048, 64, "openai"),
    ("vercel", "openai/text-embedding-3-large", 3072, 64, "openai"),
    ("synthetic", "hf:nomic-ai/nomic-embed-text-v1.5", 768, 64, "openai"),
    ("lkeap", "adp-text-embedding-0.5b", None, 64, "openai"),
    ("minimax", "embo-01", 1536, 32, "vectors"),
]
# Models with native size, whether it can be set, and US dollars per
# million tokens.
MODELS = [
    ("text-embedding-3-small", 1536, True, 0.02),
    ("text-embedding-3-large", 3072, True, 0.13),
    ("text-embedding-ada-002", 1536, False, 0.10),
]
PRICED_BACKEND = "openai"


def backend_catalogue(spark: SparkSession) -> DataFrame:
    """Back ends; a fixed small table."""
    return spark.createDataFrame(
        BACKENDS, "backend string, default_model string, native_dims int, batch_size int, response_shape string"
    )


def model_catalogue(spark: SparkSession) -> DataFrame:
    """Priced models; a fixed small table."""
    return spark.createDataFrame(MODELS, "model string, native_dims int, configurable boolean, price_per_1m_usd double")


def with_catalogue(df: DataFrame, model: str = "model") -> DataFrame:
    """Rows with the catalogue entry of their model, NULL if it is not listed."""
    catalogue = model_catalogue(df.sparkSession).withColumnRenamed("model", model)
    return df.join(F.broadcast(catalogue), model, "left")


TokenCount = Callable[[Column], Column]


def doc_stats(chunks: DataFrame, doc: str, token_count: TokenCount | None = None) -> DataFrame:
    """``chunk_count, tokens, chars`` per document, from its chunks; tokens are estimated without a tokenizer's count."""
    return chunks.groupBy(doc).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.sum((token_count or estimate_tokens)(F.col("content"))).alias("tokens"),
        F.sum(F.length("content")).alias("chars"),
    )


def page_stats(documents: DataFrame, pages: str = "pages") -> DataFrame:
    """Adds ``page_count`` and ``total_chars`` of the page texts of a document."""
    chars = F.aggregate(
        F.col(pages), F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(F.length(p), F.lit(0))
    )
    return documents.withColumns({"page_count": F.size(pages), "total_chars": chars})


def batch_totals(chunks: DataFrame, doc: str, token_count: TokenCount | None = None) -> DataFrame:
    """One row ``documents, total_chunks, total_tokens``."""
    return doc_stats(chunks, doc, token_count).agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"),
    )


def cost(tokens: Column, price_per_1m: Column) -> Column:
    """Price of a number of tokens in US dollars, to six decimals."""
    return F.round(tokens / F.lit(1_000_000.0) * price_per_1m, 6)


def cost_estimate(totals: DataFrame, backend: str, model: str) -> DataFrame:
    """Totals with ``est_cost_usd``; NULL unless the back end and the model are priced."""
    prices = {name: price for name, _, _, price in MODELS} if backend == PRICED_BACKEND else {}
    price = F.lit(prices.get(model)).cast("double")
    return totals.withColumns(
        {"backend": F.lit(backend), "model": F.lit(model), "est_cost_usd": cost(F.col("total_tokens"), price)}
    )


def pinned_identity(documents: DataFrame, key: str = "id", backend: str = "embed_backend", model: str = "embed_model") -> DataFrame:
    """One row with the back end and model of the first document; no row if it names none."""
    named = F.coalesce((F.col(backend) != "") & (F.col(model) != ""), F.lit(False))
    return earliest_by(documents, key, [backend, model]).where(named)


def space_violations(
    incoming: DataFrame,
    documents: DataFrame,
    key: str = "id",
    backend: str = "embed_backend",
    model: str = "embed_model",
) -> DataFrame:
    """Incoming rows whose back end or model is not that of the corpus, with the pinned pair.

    Vectors of different models must not be mixed. A corpus without a pin accepts all.
    """
    pin = pinned_identity(documents, key, backend, model).select(F.struct(backend, model).alias("pin"))
    pinned = incoming.withColumn("_pin", pin.scalar())
    differs = ~(F.col(backend).eqNullSafe(F.col("_pin")[backend]) & F.col(model).eqNullSafe(F.col("_pin")[model]))
    return pinned.where(F.col("_pin").isNotNull() & differs).select(
        *incoming.columns,
        F.col("_pin")[backend].alias("pinned_backend"),
        F.col("_pin")[model].alias("pinned_model"),
    )


def run_report(outcomes: DataFrame) -> DataFrame:
    """One row with counts per outcome and ``success``; the lists stay rows of ``outcomes``.

    ``outcomes`` has a ``status`` of succeeded, skipped, parse_failed or ingest_failed.
    A run is a success if no file failed while it was stored and some file succeeded, or all that
    could be parsed were skipped; a run without any parsed file is none.
    """
    counted = lambda name: F.count_if(F.col("status") == name)
    return outcomes.agg(
        counted("succeeded").alias("succeeded"),
        counted("skipped").alias("skipped"),
        counted("parse_failed").alias("parse_failed"),
        counted("ingest_failed").alias("ingest_failed"),
    ).withColumn("success", (F.col("succeeded") + F.col("skipped") > 0) & (F.col("ingest_failed") == 0))


def outcome_rows(outcomes: DataFrame) -> DataFrame:
    """The lists of a report: ``status, file, detail``, sorted."""
    return outcomes.select("status", "file", "detail").orderBy("status", F.lower("file"), "file")
