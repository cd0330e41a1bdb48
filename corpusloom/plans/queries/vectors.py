"""Vector and search queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions.documents import rank_rows_json
from corpusloom.functions.vectors import (
    code_bits, code_words, cosine_distance, fit_vector, hamming, literal_to_vector, pad_vector, query_words,
    rounded_vector, split_by_dims, vector_literal_column, vector_to_literal,
)
from corpusloom.operators.search import (
    exact_knn, find_closest, find_closest_batch, recall_at_k, store_codes,
)
from corpusloom.plans.queries.common import long, table
from corpusloom.session import work_folder

DIMS = 64


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def first_vector(df: DataFrame) -> list[float]:
    """The vector with the lowest id, used as the caller's query."""
    known = df.where(F.col("embedding").isNotNull())
    return list(known.agg(F.min_by("embedding", "vec_id").alias("v")).first()["v"])


def label_queries(df: DataFrame) -> DataFrame:
    """One query per label: its vector with the lowest id."""
    known = df.where(F.col("embedding").isNotNull())
    return known.groupBy(long("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query"))


def _closest(df: DataFrame, **kwargs) -> DataFrame:
    found = find_closest(df, "vec_id", "embedding", first_vector(df), **kwargs)
    return found.select("vec_id", "label", F.round("distance", 6).alias("distance"))


def knn_two_stage(spark: SparkSession, folder: str) -> DataFrame:
    return _closest(embeddings(spark, folder))


def knn_stored_codes(spark: SparkSession, folder: str) -> DataFrame:
    df = embeddings(spark, folder)
    path = work_folder(spark, "codes")
    store_codes(df, "vec_id", "embedding", DIMS, path)
    return _closest(df, codes=store_codes(df, "vec_id", "embedding", DIMS, path))


def knn_clamped(spark: SparkSession, folder: str) -> DataFrame:
    return _closest(embeddings(spark, folder), k=0, rerank_factor=None)


def _batch(df: DataFrame, **kwargs) -> DataFrame:
    return find_closest_batch(df, "vec_id", "embedding", label_queries(df), "query_id", "query", DIMS, **kwargs)


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("query_id", "row_id", long("rank").alias("rank"), F.round("distance", 6).alias("distance"))


def knn_batch(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(_batch(embeddings(spark, folder)))


def knn_batch_fragments(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(_batch(embeddings(spark, folder), query_limit=0))


def knn_exact(spark: SparkSession, folder: str) -> DataFrame:
    df = embeddings(spark, folder)
    return _ranked(exact_knn(df, "vec_id", "embedding", label_queries(df), "query_id", "query"))


def knn_recall(spark: SparkSession, folder: str) -> DataFrame:
    df = embeddings(spark, folder)
    exact = exact_knn(df, "vec_id", "embedding", label_queries(df), "query_id", "query")
    return recall_at_k(_batch(df), exact).withColumn("recall", F.round("recall", 6))


def knn_json(spark: SparkSession, folder: str) -> DataFrame:
    df = embeddings(spark, folder)
    found = find_closest(df, "vec_id", "embedding", first_vector(df))
    answer = rank_rows_json(found, "vec_id", include_d=True)
    item = "array<struct<vec_id: bigint, label: int, distance: double, d: double>>"
    return answer.select(F.posexplode(F.from_json("result", item)).alias("pos", "row")).select(
        long("pos").alias("pos"), "row.vec_id", "row.label", F.round("row.distance", 6).alias("distance"),
        F.round("row.d", 6).alias("d"),
    )


def vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    df = embeddings(spark, folder)
    return df.select("vec_id", code_bits(code_words(F.col("embedding"), DIMS), DIMS).alias("bits"))


def vector_distances(spark: SparkSession, folder: str) -> DataFrame:
    df = embeddings(spark, folder)
    query = first_vector(df)
    target = [F.lit(w).cast("bigint") for w in query_words(query)]
    return df.select(
        "vec_id",
        long(hamming(code_words(F.col("embedding"), DIMS), target)).alias("hamming"),
        F.round(cosine_distance(F.col("embedding"), vector_literal_column(query)), 6).alias("distance"),
    )


def vector_pad(spark: SparkSession, folder: str) -> DataFrame:
    df = embeddings(spark, folder)
    return df.select("vec_id", vector_to_literal(pad_vector(F.col("embedding"), 80)).alias("literal"))


def vector_fit(spark: SparkSession, folder: str) -> DataFrame:
    df = embeddings(spark, folder)
    return df.select(
        "vec_id",
        vector_to_literal(fit_vector(F.col("embedding"), 48)).alias("shorter"),
        vector_to_literal(fit_vector(F.col("embedding"), 70)).alias("longer"),
    )


def vector_literal(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings(spark, folder).select("vec_id", vector_to_literal(F.col("embedding")).alias("literal"))


def literal_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    df = embeddings(spark, folder).select(
        "vec_id",
        literal_to_vector(vector_to_literal(F.col("embedding")), DIMS).alias("parsed"),
        rounded_vector(F.col("embedding")).alias("rounded"),
    )
    total = F.aggregate("parsed", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return df.select(
        "vec_id",
        long(F.size("parsed")).alias("dims"),
        F.round(total, 6).alias("total"),
        (F.col("parsed") == F.col("rounded")).alias("same"),
    )


def dims_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    cut = embeddings(spark, folder).withColumn("v", F.slice("embedding", F.lit(1), F.lit(60) + F.col("label")))
    good, bad = split_by_dims(cut, "v", DIMS)
    return good.select("vec_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("vec_id", "error"))


_BITS = "array_to_string(list_transform({v}, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')"
_ONE = f"""
WITH q AS (SELECT arg_min(embedding, vec_id)::DOUBLE[] AS qv FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, qv,
  bit_count(xor({_BITS.format(v='embedding')}::BIT, {_BITS.format(v='qv')}::BIT)) AS h
  FROM embeddings, q WHERE embedding IS NOT NULL),
c AS (SELECT * FROM s ORDER BY h, vec_id LIMIT {{wanted}}),
f AS (SELECT vec_id, label, list_cosine_distance(v, qv) AS d FROM c ORDER BY d, vec_id LIMIT {{k}})
"""
_KNN = "SELECT vec_id, label, round(d, 6) AS distance FROM f"
_MANY = f"""
WITH q AS (SELECT label::BIGINT AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS qv FROM embeddings
  WHERE embedding IS NOT NULL GROUP BY label),
s AS (SELECT query_id, vec_id, embedding::DOUBLE[] AS v, qv,
  bit_count(xor({_BITS.format(v='embedding')}::BIT, {_BITS.format(v='qv')}::BIT)) AS h
  FROM embeddings, q WHERE embedding IS NOT NULL),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY h, vec_id) <= 20),
d AS (SELECT query_id, vec_id, list_cosine_distance(v, qv) AS d FROM c),
found AS (SELECT query_id, vec_id AS row_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank
  FROM d QUALIFY rank <= 5),
e AS (SELECT query_id, vec_id, list_cosine_distance(v, qv) AS d FROM s),
exact AS (SELECT query_id, vec_id AS row_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank
  FROM e QUALIFY rank <= 5)
"""
_BATCH = _MANY + "SELECT query_id, row_id, rank, round(d, 6) AS distance FROM found"


def _literal(v: str) -> str:
    return f"'[' || array_to_string(list_transform({v}, lambda x: printf('%.7f', x::DOUBLE)), ',') || ']'"


QUERIES = {
    "knn_two_stage": (knn_two_stage, _ONE.format(wanted=20, k=5) + _KNN),
    "knn_stored_codes": (knn_stored_codes, _ONE.format(wanted=20, k=5) + _KNN),
    "knn_clamped": (knn_clamped, _ONE.format(wanted=1, k=1) + _KNN),
    "knn_batch": (knn_batch, _BATCH),
    "knn_batch_fragments": (knn_batch_fragments, _BATCH),
    "knn_exact": (knn_exact, _MANY + "SELECT query_id, row_id, rank, round(d, 6) AS distance FROM exact"),
    "knn_recall": (
        knn_recall,
        _MANY
        + """SELECT exact.query_id, count(found.row_id) AS hits, count(*) AS wanted,
        round(count(found.row_id) / count(*), 6) AS recall
        FROM exact LEFT JOIN found USING (query_id, row_id) GROUP BY exact.query_id""",
    ),
    "knn_json": (
        knn_json,
        _ONE.format(wanted=20, k=5)
        + "SELECT row_number() OVER (ORDER BY d, vec_id) - 1 AS pos, vec_id, label, round(d, 6) AS distance, round(d, 6) AS d FROM f",
    ),
    "vector_codes": (vector_codes, f"SELECT vec_id, {_BITS.format(v='embedding')} AS bits FROM embeddings"),
    "vector_distances": (
        vector_distances,
        _ONE.format(wanted=1, k=1)
        + "SELECT vec_id, h::BIGINT AS hamming, round(list_cosine_distance(v, qv), 6) AS distance FROM s",
    ),
    "vector_pad": (
        vector_pad,
        f"SELECT vec_id, {_literal('list_concat(embedding, list_transform(range(80 - len(embedding)), lambda i: 0::FLOAT))')} AS literal FROM embeddings",
    ),
    "vector_fit": (
        vector_fit,
        f"""SELECT vec_id, {_literal('embedding[1:48]')} AS shorter,
        {_literal('list_concat(embedding, list_transform(range(70 - len(embedding)), lambda i: 0::FLOAT))')} AS longer
        FROM embeddings""",
    ),
    "vector_literal": (vector_literal, f"SELECT vec_id, {_literal('embedding')} AS literal FROM embeddings"),
    "literal_round_trip": (
        literal_round_trip,
        f"""SELECT vec_id, len(embedding) AS dims,
        round(list_sum(list_transform(embedding, lambda x: printf('%.7f', x::DOUBLE)::FLOAT::DOUBLE)), 6) AS total,
        true AS same FROM embeddings""",
    ),
    "dims_quarantine": (
        dims_quarantine,
        """SELECT vec_id, CASE WHEN len(embedding[1:60 + label]) <> 64
        THEN 'embedding has ' || len(embedding[1:60 + label]) || ' dims, expected 64' END AS error FROM embeddings""",
    ),
}
