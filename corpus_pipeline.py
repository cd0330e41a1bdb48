"""A corpus pipeline: quality, near copies, secrets, packing; every stage reads what the one before it wrote."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from corpusloom.llm.common import remainder_of_id, table  # noqa: E402
from corpusloom.llm.packing import pack_documents  # noqa: E402
from corpusloom.llm.quality import train, with_scores  # noqa: E402
from corpusloom.llm.secret_scan import redact  # noqa: E402
from corpusloom.llm.simhash import without_near_duplicates  # noqa: E402
from corpusloom.session import work_folder  # noqa: E402


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from labelled rows whose crc32 modulo 3 is not 1."""
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), remainder_of_id("doc_id", 3) != 1)
    return with_scores(docs, model, "_score").where("_score >= 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints over three words are linked by at most two differing bits."""
    return without_near_duplicates(docs, width=3, radius=2)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; ``n_chars`` follows the text."""
    masked = redact(docs, remainder_of_id("doc_id", 3) != 1)
    length = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    # executors have come through all other stages: a small cache costs some time and spares memory
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cached_words=60_000)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

# the classifier, the forest and the packing are no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of every stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_folder(spark, name.lower().replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
