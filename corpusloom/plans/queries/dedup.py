"""Fingerprint and collision queries.

All documents arrive as files named by source and language, so many share a name.
The labelled documents are stored already; the labels decide how much of the stored
fingerprint is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.operators.dedup import (
    collision_decision, collision_ids, duplicate_groups, duplicate_members, fingerprint_match, match_reason, new_only,
)
from corpusloom.plans.queries.common import table
from corpusloom.sources.files import fingerprint


def _files(documents: DataFrame) -> DataFrame:
    mtime = F.col("n_chars") / 4
    return documents.select(
        "doc_id",
        F.concat("source", F.lit("-"), "lang", F.lit(".txt")).alias("filename"),
        fingerprint(F.octet_length("text"), mtime, F.col("text")).alias("fingerprint"),
    )


def _existing(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    stored = _files(table(spark, folder, "documents")).join(labels, "doc_id")
    fp = F.col("fingerprint")
    known = (
        F.when(F.col("toxic") == 1, F.lit(None))
        .when(F.col("quality") == 0, F.struct(fp["file_size"].alias("file_size"), (fp["mtime"] + 0.0005).alias("mtime"), F.lit("").alias("sha256")))
        .otherwise(fp)
    )
    return stored.select(F.col("doc_id").alias("id"), "filename", known.alias("fingerprint"))


def _new(spark: SparkSession, folder: str) -> DataFrame:
    return _files(table(spark, folder, "documents"))


def _decisions(spark: SparkSession, folder: str, policy: str) -> DataFrame:
    found = collision_decision(_new(spark, folder), _existing(spark, folder), policy, key="doc_id")
    return found.select("doc_id", "filename", "decision", "matched_id", "reason")


def collision_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return _decisions(spark, folder, "fingerprint")


def collision_skip(spark: SparkSession, folder: str) -> DataFrame:
    return _decisions(spark, folder, "skip")


def collision_fail(spark: SparkSession, folder: str) -> DataFrame:
    return _decisions(spark, folder, "fail")


def collision_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return _decisions(spark, folder, "ingest")


def colliding_ids(spark: SparkSession, folder: str) -> DataFrame:
    return collision_ids(_new(spark, folder), _existing(spark, folder))


def new_names(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "documents").join(table(spark, folder, "labels").where("toxic = 1"), "doc_id")
    return new_only(_new(spark, folder), _files(stored)).select("doc_id", "filename")


def fingerprint_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored document against the file that has its number now, cut by one character where the label is bad."""
    documents = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    changed = documents.withColumn(
        "text", F.when((F.col("quality") == 1) & (F.col("toxic") == 0) & (F.col("lang") == "en"), F.concat("text", F.lit("."))).otherwise(F.col("text"))
    )
    new = _files(changed).select("doc_id", F.col("fingerprint").alias("new"))
    old = _existing(spark, folder).select(F.col("id").alias("doc_id"), F.col("fingerprint").alias("old"))
    return new.join(old, "doc_id").select(
        "doc_id",
        fingerprint_match(F.col("new"), F.col("old")).alias("match"),
        match_reason(F.col("new"), F.col("old")).alias("reason"),
    )


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    fp = F.col("fingerprint")
    return _new(spark, folder).select(
        "doc_id", fp["file_size"].alias("file_size"), fp["mtime"].alias("mtime"), fp["sha256"].alias("sha256")
    )


def duplicate_texts(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_groups(table(spark, folder, "documents"), "doc_id", F.sha2("text", 256))


def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_members(table(spark, folder, "documents"), "doc_id", F.sha2("text", 256))


_NEW = """n AS (SELECT doc_id, source || '-' || lang || '.txt' AS filename, strlen(text)::BIGINT AS size, n_chars / 4 AS mtime,
  sha256(text) AS sha FROM documents)"""
_BASE = f"""WITH {_NEW},
e AS (SELECT doc_id AS id, filename, CASE WHEN toxic = 1 THEN NULL ELSE size END AS size,
  CASE WHEN toxic = 1 THEN NULL WHEN quality = 0 THEN mtime + 0.0005 ELSE mtime END AS mtime,
  CASE WHEN toxic = 1 THEN NULL WHEN quality = 0 THEN '' ELSE sha END AS sha FROM n JOIN labels USING (doc_id)),
names AS (SELECT filename, count(*) AS n_existing, min(id) || ' of ' || count(*) AS ids,
  count(*) FILTER (coalesce(sha, '') = '' AND (size IS NULL OR mtime IS NULL)) AS n_no_fp FROM e GROUP BY filename)"""
_PAIRS = """,
p AS (SELECT doc_id, id, CASE WHEN coalesce(e.sha, '') <> '' THEN CASE WHEN e.sha = n.sha THEN 'sha256 match' END
  WHEN e.size = n.size AND abs(e.mtime - n.mtime) < 0.001 THEN 'size+mtime match' END AS why
  FROM n JOIN e USING (filename)),
m AS (SELECT doc_id, min(id) AS matched_id, arg_min(why, id) AS why FROM p WHERE why IS NOT NULL GROUP BY doc_id)
"""
_DECIDED = """SELECT doc_id, filename, CASE WHEN matched_id IS NOT NULL OR n_no_fp = n_existing THEN 'skip' ELSE 'keep' END AS decision,
  matched_id, CASE WHEN matched_id IS NOT NULL THEN 'fingerprint duplicate of doc_id=' || matched_id || ' (' || why || ')'
  WHEN n_no_fp = n_existing THEN 'filename match (lowest doc_id=' || ids || ') has no fingerprint in DB; assuming duplicate' END AS reason
  FROM n LEFT JOIN names USING (filename) LEFT JOIN m USING (doc_id)"""


def _named(word: str, sep: str, policy: str) -> str:
    return f"""{_BASE} SELECT doc_id, filename, CASE WHEN ids IS NULL THEN 'keep' ELSE '{word}' END AS decision,
    NULL::BIGINT AS matched_id, 'filename match (lowest doc_id=' || ids || '){sep}policy={policy}' AS reason
    FROM n LEFT JOIN names USING (filename)"""


QUERIES = {
    "collision_fingerprint": (collision_fingerprint, _BASE + _PAIRS + _DECIDED),
    "collision_skip": (collision_skip, _named("skip", ", ", "skip")),
    "collision_fail": (collision_fail, _named("abort", "; ", "fail")),
    "collision_ingest": (
        collision_ingest,
        f"WITH {_NEW} SELECT doc_id, filename, 'keep' AS decision, NULL::BIGINT AS matched_id, NULL::VARCHAR AS reason FROM n",
    ),
    "collision_ids": (colliding_ids, _BASE + " SELECT filename, id FROM e"),
    "new_only": (
        new_names,
        f"""WITH {_NEW} SELECT doc_id, filename FROM n WHERE filename NOT IN
        (SELECT filename FROM n JOIN labels USING (doc_id) WHERE toxic = 1)""",
    ),
    "fingerprint_classes": (
        fingerprint_classes,
        """WITH c AS (SELECT doc_id, quality, toxic, sha256(text) AS old_sha, sha256(text || '.') AS dot_sha, lang
          FROM documents JOIN labels USING (doc_id))
        SELECT doc_id, CASE WHEN toxic = 1 THEN 'none' WHEN quality = 0 THEN 'match_stat'
          WHEN lang = 'en' THEN 'diff_sha' ELSE 'match_sha' END AS match,
        CASE WHEN toxic = 1 THEN 'no fingerprint in existing row' WHEN quality = 0 THEN 'size+mtime match'
          WHEN lang = 'en' THEN 'sha256 differs (db=' || substring(old_sha, 1, 12) || '..., new=' || substring(dot_sha, 1, 12) || '...)'
          ELSE 'sha256 match' END AS reason FROM c""",
    ),
    "fingerprints": (fingerprints, f"WITH {_NEW} SELECT doc_id, size AS file_size, mtime, sha AS sha256 FROM n"),
    "duplicate_groups": (
        duplicate_texts,
        "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    ),
    "duplicate_members": (
        duplicate_rows,
        """SELECT doc_id, sha256(text) AS sha256, first_id FROM (SELECT *, count(*) OVER w AS n, min(doc_id) OVER w AS first_id
        FROM documents WINDOW w AS (PARTITION BY text)) WHERE n > 1""",
    ),
}
