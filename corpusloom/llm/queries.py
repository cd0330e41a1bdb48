"""Registered queries of the training-data operators: name to (Spark query, equivalent SQL or None)."""

from __future__ import annotations

from itertools import permutations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm.balltree import top_k
from corpusloom.llm.bpe import token_digests
from corpusloom.llm.common import remainder_of_id, table
from corpusloom.llm.ctph import fingerprint_documents
from corpusloom.llm.digest_tree import exact_duplicates
from corpusloom.llm.filter_audit import audit
from corpusloom.llm.heap_centroids import clustered
from corpusloom.llm.mixing import score_documents
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.quality import train, with_scores
from corpusloom.llm.secret_scan import scan
from corpusloom.llm.simhash import near_duplicates
from corpusloom.llm.token_file import read_token_files, write_token_files
from corpusloom.llm.warc import BASE32, read_manifest, write_warc

_PAGE_OF = "regexp_extract({}, '^urn:page:(-?[0-9]+)$', 1)"
BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE, WORD_BPE_SIZE = "word_bpe_49k.json", 49_408


def op1_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    manifest = write_warc(table(spark, folder, "pages"))
    return read_manifest(manifest, payloads=False).where("gap is null").select(
        F.expr("try_cast(" + _PAGE_OF.format("record_id") + " as bigint)").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.expr("try_cast(" + _PAGE_OF.format("refers_to") + " as bigint)").alias("refers_to"),
    )


def op2_quality_nbsvm(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = train(documents, table(spark, folder, "labels"), remainder_of_id("doc_id", 3) != 1)
    scored = with_scores(documents, model)
    held_out = F.coalesce(remainder_of_id("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    manifest = write_token_files(table(spark, folder, "documents"), path, end_id=1, vocabulary=WORD_BPE_SIZE)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))


def op5_simhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Every finding; the forest learns from documents whose crc32 modulo 3 is not 1. Values are given as digests only."""
    found = scan(table(spark, folder, "documents"), remainder_of_id("doc_id", 3) != 1)
    return found.select("doc_id", "n", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), "label", "score", "is_secret")


def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


def op8_piecewise_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_documents(table(spark, folder, "documents"))


def op9_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"), remainder_of_id("doc_id", 7) == 2)


def op10_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op11_digest_tree(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_heap_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return clustered(table(spark, folder, "embeddings"))


# 5 hex digits of the digest make 4 letters
_SQL_BASE32 = (
    "list_aggregate(list_transform(range(0, 32), lambda i: substr('" + BASE32 + "', 1 + "
    "((('0x' || substr(sha1(coalesce(html, '')), (i // 4)::INT * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), "
    "'string_agg', '')"
)
SQL_WARC = f"""
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, {_SQL_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""
SQL_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
SQL_EXACT = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept,
       sha256(t) AS text_sha256
FROM t WINDOW same AS (PARTITION BY t)
"""
_ORDERS = ", ".join(f"('{''.join(order)}')" for order in permutations("ABCDE"))
SQL_AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, doc_id,
             CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
             || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
             count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM f GROUP BY ALL),
o AS (SELECT o AS filter_order, s::INTEGER AS step, substr(o, s, 1) AS x, substr(o, 1, s - 1) AS before
      FROM (VALUES {_ORDERS}) AS v(o), range(1, 6) AS r(s)),
c AS (SELECT g.*, o.*, contains(fails, x) AS failed,
             len(list_filter(string_split(fails, ''), lambda y: y <> '' AND contains(before, y))) > 0 AS earlier FROM g, o),
a AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (NOT failed AND NOT earlier), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (failed AND NOT earlier), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (failed AND earlier), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (fails = x), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (failed AND NOT earlier), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (failed AND NOT earlier), 0)::BIGINT AS toxic_lost FROM c GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM a
"""


def _sql_centroids(clusters: int = 40, rounds: int = 5) -> str:
    """One table of centroids and one of assignments a round."""
    parts = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INTEGER AS j, e FROM v
            ORDER BY j LIMIT {clusters})""",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT vec_id, any_value(v.e) AS e,
            min(ROW(list_dot_product(v.e, v.e) + list_dot_product(c.e, c.e) - 2 * list_dot_product(v.e, c.e), j)) AS m
            FROM v, c{n} c GROUP BY vec_id)""")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(any_value(n.e), any_value(c.e)) AS e FROM c{n} c LEFT JOIN (
                SELECT j, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS e FROM (
                    SELECT m[2] AS j, i, sum(e[i])::BIGINT AS s, count(*) AS n FROM a{n}, range(1, 65) AS r(i) GROUP BY ALL)
                GROUP BY j) n ON n.j = c.j GROUP BY c.j)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, j AS cluster, m[1]::BIGINT AS distance, (sum(m[1]) OVER (PARTITION BY j))::BIGINT AS cluster_inertia,
       (sum(m[1]) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.e, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.j = a.m[2]"""


QUERIES = {
    "op1_warc_salvage": (op1_warc_salvage, SQL_WARC),
    "op2_quality_nbsvm": (op2_quality_nbsvm, None),
    "op3_token_files": (op3_token_files, None),
    "op4_bpe_codec": (op4_bpe_codec, None),
    "op5_simhash_neardup": (op5_simhash_neardup, None),
    "op6_secret_forest": (op6_secret_forest, None),
    "op7_best_fit_packing": (op7_best_fit_packing, None),
    "op8_piecewise_hashes": (op8_piecewise_hashes, None),
    "op9_context_mixing": (op9_context_mixing, None),
    "op10_exact_topk": (op10_exact_topk, SQL_TOPK),
    "op11_digest_tree": (op11_digest_tree, SQL_EXACT),
    "op12_filter_audit": (op12_filter_audit, SQL_AUDIT),
    "op13_heap_centroids": (op13_heap_centroids, _sql_centroids()),
}
