"""JSON, HAL, XML and deployed-function queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.deploy import call_function, call_table_function, deploy_function
from corpusloom.functions.documents import (
    hal_elements, hal_error, hal_page, json_build, json_each_text, metadata_get, parse_embedding_response, xml_values,
)
from corpusloom.plans.queries.common import long, table


def event_props(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "props", F.parse_json("props").alias("variant"))
    return events.select(
        "event_id",
        metadata_get(events, "props", "$.k", "bigint").alias("k"),
        metadata_get(events, "variant", "$.k", "bigint").alias("k_variant"),
        metadata_get(events, "variant", "$.absent").alias("absent"),
    )


def event_pairs(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "props")
    return json_each_text(events, "props").select("event_id", long("pos").alias("pos"), "key", "value")


def order_objects(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    built = orders.select(
        "o_orderkey", json_build(orders, drop=["o_custkey"], extra={"doubled": F.col("o_custkey") * 2}).alias("obj")
    )
    return built


def _hal(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a HAL collection of itself and its customer."""
    link = lambda title: F.struct(F.struct(F.concat(F.lit("/statuses/"), title).alias("href"), title.alias("title")).alias("status"))
    element = lambda key, subject, title: F.struct(
        key.alias("id"), subject.alias("subject"), F.lit(1).alias("lockVersion"), link(title).alias("_links")
    )
    elements = F.array(
        element(F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")),
        element(F.col("o_custkey"), F.lit("customer"), F.lit("open")),
    )
    doc = F.to_json(
        F.struct(
            F.lit(2).alias("total"), F.lit(2).alias("count"), F.lit(25).alias("pageSize"), F.lit(1).alias("offset"),
            F.struct(elements.alias("elements")).alias("_embedded"),
        )
    )
    return table(spark, folder, "orders").select("o_orderkey", doc.alias("doc"))


def hal_rows(spark: SparkSession, folder: str) -> DataFrame:
    return hal_elements(_hal(spark, folder), "doc", keep=["o_orderkey"])


def hal_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _hal(spark, folder).select("o_orderkey", hal_page(F.col("doc")).alias("p")).select(
        "o_orderkey", "p.total", "p.count", "p.pageSize", "p.offset"
    )


def hal_errors(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "Error").otherwise("Event")
    status = F.when(F.col("value") > 300, 401).when(F.col("value") > 200, 409).when(F.col("value") > 100, 422).otherwise(500)
    doc = F.to_json(
        F.struct(kind.alias("_type"), F.concat(F.lit("urn:"), "event_type").alias("errorIdentifier"), F.col("user_id").cast("string").alias("message"))
    )
    return table(spark, folder, "events").select("event_id", hal_error(doc, status).alias("e")).select("event_id", "e.*")


def xml_links(spark: SparkSession, folder: str) -> DataFrame:
    escaped = F.regexp_replace(F.regexp_replace("url", "&", "&amp;"), "<", "&lt;")
    xml = F.concat(
        F.lit('<d:multistatus xmlns:d="DAV:" xmlns:oc="urn:files"><d:response><d:href>'), escaped,
        F.lit("</d:href><d:prop><oc:fileid>"), F.col("page_id").cast("string"),
        F.lit("</oc:fileid></d:prop></d:response><d:response><d:href>/second</d:href></d:response></d:multistatus>"),
    )
    pages = table(spark, folder, "pages").select("page_id", xml.alias("xml"))
    def named(name: str) -> Column:
        return F.transform(xml_values(F.col("xml"), name), lambda value: F.struct(value.alias("value"), F.lit(name).alias("name")))

    return pages.select("page_id", F.explode(F.concat(named("href"), named("fileid"))).alias("v")).select("page_id", "v.*")


def model_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors wrapped in the three answer shapes, and read back."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    bad = F.col("label") == 9
    rows = vectors.select(
        "vec_id",
        F.to_json(F.struct(F.array(F.struct(F.col("v").alias("embedding")), F.struct(F.col("v").alias("embedding"))).alias("data"))).alias("openai"),
        F.when(bad, F.lit('{"object":"list"}')).otherwise(F.to_json(F.struct(F.col("v").alias("embedding")))).alias("single"),
        F.when(bad, F.lit('{"base_resp":{"status_code":1004,"status_msg":"login fail"}}'))
        .otherwise(F.to_json(F.struct(F.array("v").alias("vectors"), F.struct(F.lit(0).alias("status_code")).alias("base_resp"))))
        .alias("vectors"),
    )
    parsed = rows.select("vec_id", *[parse_embedding_response(F.col(s), s).alias(s) for s in ("openai", "single", "vectors")])
    vector = lambda s: F.try_element_at(F.col(s)["vectors"], F.lit(1))
    # of all components: each as an integer, weighted by its place
    first = lambda s: F.aggregate(
        F.transform(vector(s), lambda x, i: F.round(x * 1_000_000).cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, b: a + b
    )
    return parsed.select(
        "vec_id", long(F.size(F.col("openai")["vectors"])).alias("n"), first("openai").alias("openai"),
        first("single").alias("single"), F.col("single")["error"].alias("single_error"),
        first("vectors").alias("vectors"), F.col("vectors")["error"].alias("vectors_error"),
    )


def deployed_function(spark: SparkSession, folder: str) -> DataFrame:
    deploy_function(spark, "token_estimate", "greatest(1, floor(length(body) / 4))", "body STRING", "BIGINT")
    documents = table(spark, folder, "documents")
    return documents.select("doc_id", F.call_function("token_estimate", F.col("text")).alias("tokens"))


def called_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """A deployed function, called with named arguments on a sum over the whole table."""
    french = table(spark, folder, "documents").where("lang = 'fr' AND n_chars >= 100")
    total = french.agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n")).first()["n"]
    deploy_function(spark, "tokens_of", "greatest(least_tokens, floor(characters / 4))", "characters BIGINT, least_tokens BIGINT", "BIGINT")
    return call_function(spark, "tokens_of", least_tokens=1, characters=total)


def deployed_table_function(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "documents").createOrReplaceTempView("stored_documents")
    deploy_function(
        spark, "documents_in", "SELECT doc_id, n_chars FROM stored_documents WHERE lang = wanted",
        "wanted STRING", "TABLE(doc_id BIGINT, n_chars BIGINT)",
    )
    return call_table_function(spark, "documents_in", wanted="fr")


QUERIES = {
    "event_props": (
        event_props, "SELECT event_id, (props->>'$.k')::BIGINT AS k, (props->>'$.k')::BIGINT AS k_variant, NULL::VARCHAR AS absent FROM events"
    ),
    "json_each_text": (
        event_pairs, "SELECT event_id, 0::BIGINT AS pos, 'k' AS key, props->>'$.k' AS value FROM events"
    ),
    "json_build": (
        order_objects,
        """SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"'
        || o_orderpriority || '","doubled":' || o_custkey * 2 || '}' AS obj FROM orders""",
    ),
    "hal_elements": (
        hal_rows,
        """SELECT o_orderkey, o_orderkey AS id, o_orderpriority AS subject, o_orderstatus AS status FROM orders
        UNION ALL SELECT o_orderkey, o_custkey, 'customer', 'open' FROM orders""",
    ),
    "hal_page": (
        hal_pages,
        """SELECT o_orderkey, 2::BIGINT AS total, 2::BIGINT AS count, 25::BIGINT AS "pageSize", 1::BIGINT AS "offset" FROM orders""",
    ),
    "hal_error": (
        hal_errors,
        """SELECT event_id, event_type = 'error' AS is_error, CASE WHEN event_type = 'error' THEN 'urn:error' END AS identifier,
        CASE WHEN event_type = 'error' THEN user_id::VARCHAR END AS message, CASE WHEN event_type = 'error' THEN
        CASE WHEN value > 300 THEN 'stop' WHEN value > 200 THEN 'refetch' WHEN value > 100 THEN 'fix_input' ELSE 'report' END END AS action
        FROM events""",
    ),
    "xml_values": (
        xml_links,
        """SELECT page_id, url AS value, 'href' AS name FROM pages UNION ALL SELECT page_id, '/second', 'href' FROM pages
        UNION ALL SELECT page_id, page_id::VARCHAR, 'fileid' FROM pages""",
    ),
    "embedding_response": (
        model_answers,
        """SELECT vec_id, 2::BIGINT AS n, {digest} AS openai,
        CASE WHEN label <> 9 THEN {digest} END AS single,
        CASE WHEN label = 9 THEN 'embedding response missing ''data[0].embedding'' or ''embedding''' END AS single_error,
        CASE WHEN label <> 9 THEN {digest} END AS vectors,
        CASE WHEN label = 9 THEN 'model error 1004: login fail' END AS vectors_error FROM embeddings""".format(
            digest="list_sum(list_transform(embedding, lambda x, i: round(x::DOUBLE * 1000000)::BIGINT * i))::BIGINT"
        ),
    ),
    "named_call": (called_by_name, "SELECT greatest(1, coalesce(sum(n_chars), 0)::BIGINT // 4)::BIGINT AS result FROM documents WHERE lang = 'fr' AND n_chars >= 100"),
    "sql_function": (deployed_function, "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents"),
    "table_function": (deployed_table_function, "SELECT doc_id, n_chars FROM documents WHERE lang = 'fr'"),
}
