"""Table queries over orders, line items, customers and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.operators.keys import append_rows, assign_seq, pk_violations
from corpusloom.operators.postings import Postings, store_postings
from corpusloom.operators.search import top_k_per_query
from corpusloom.operators.tables import (
    Pages, apply_filters, cascade_delete, count_mismatches, delete_where, idempotent_add, insert_default_if_absent,
    latest_by_key, optimistic_update, order_columns, orphans, page, page_envelope, read_table, update_where,
)
from corpusloom.plans.queries.common import long, table
from corpusloom.session import work_folder
from corpusloom.sources.files import name_columns
from corpusloom.sources.schema import conform, declare_schema


def _filter(field: str, operator: str, *values: object) -> dict:
    return {field: {"operator": operator, "values": list(values)}}


def table_filter_page(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(
        table(spark, folder, "orders"),
        select=["o_orderkey", "o_custkey", "o_totalprice"],
        filters=[_filter("o_orderstatus", "eq", "O"), _filter("o_totalprice", "gt", "100000")],
        order=[("o_totalprice", "desc"), ("o_orderkey", "asc")],
        limit=25,
        offset=50,
    )


def filter_operators(spark: SparkSession, folder: str) -> DataFrame:
    return apply_filters(
        table(spark, folder, "orders"),
        [
            _filter("o_orderpriority", "in", "1-URGENT", "2-HIGH", "5-LOW"),
            _filter("o_orderstatus", "neq", "F"),
            _filter("o_totalprice", "gte", "1000.5"),
            _filter("o_totalprice", "lt", 400000),
            _filter("o_orderkey", "lte", "1000000000"),
            _filter("o_custkey", "not_null"),
        ],
    ).select("o_orderkey", "o_orderstatus", "o_orderpriority")


def null_filter(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("state", F.nullif("o_orderstatus", F.lit("P")))
    return apply_filters(orders, [_filter("state", "is", "null")]).select("o_orderkey", "o_orderstatus")


def open_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    states = orders.groupBy("o_orderstatus").agg(F.max("o_orderdate").alias("last"))
    still_open = states.where(F.col("o_orderstatus") != "F").select("o_orderstatus")
    return apply_filters(orders, [_filter("o_orderstatus", "o")], still_open).select("o_orderkey", "o_orderstatus")


def null_order(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every order in two sorts on a column with NULLs."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("state"))
    down = assign_seq(orders, "place", order_columns([("state", "desc"), ("o_orderkey", "asc")]))
    up = assign_seq(orders, "place", order_columns([("state", "asc"), ("o_orderkey", "desc")]))
    return down.withColumn("sort", F.lit("desc")).unionByName(up.withColumn("sort", F.lit("asc")))


def orders_page(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return page(orders, 3, 25, [("o_totalprice", "desc"), ("o_orderkey", "asc")])


def orders_deep_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page from the middle of a sorted table that was written once."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return Pages(orders, [("o_totalprice", "desc"), ("o_orderkey", "asc")]).page(31, 25)


def orders_envelope(spark: SparkSession, folder: str) -> DataFrame:
    found = page_envelope(table(spark, folder, "orders"), 3, 25)
    return found.select("total", "count", long("pageSize").alias("pageSize"), long("offset").alias("offset"))


def like_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return apply_filters(table(spark, folder, "customer"), [_filter("c_name", "like", "Customer#*7*")]).select("c_custkey", "c_name")


def ilike_lookup(spark: SparkSession, folder: str) -> DataFrame:
    found = apply_filters(table(spark, folder, "documents"), [_filter("text", "ilike", "*TION the*")])
    return found.select("doc_id", "lang")


def fts_lookup(spark: SparkSession, folder: str) -> DataFrame:
    found = apply_filters(table(spark, folder, "documents"), [_filter("text", "fts", "The", "and")])
    return found.select("doc_id", "lang")


def fts_by_postings(spark: SparkSession, folder: str) -> DataFrame:
    """The same look-up through a posting table."""
    documents, path = table(spark, folder, "documents"), work_folder(spark, "postings")
    store_postings(documents, "doc_id", "text", path)
    return Postings(spark, path, "doc_id").lookup(documents, "text", ["The", "and"]).select("doc_id", "lang")


def update_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return update_where(
        orders,
        F.nullif("o_orderstatus", F.lit("P")) == "O",
        {"o_orderpriority": "0-NONE", "o_totalprice": F.col("o_totalprice") + 1},
    )


def delete_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return delete_where(orders, F.nullif("o_orderstatus", F.lit("P")) == "O")


def cascade_lines(spark: SparkSession, folder: str) -> DataFrame:
    deleted = table(spark, folder, "orders").where(F.col("o_orderstatus") == "F")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return cascade_delete(lines, "l_orderkey", deleted, "o_orderkey")


def orphan_lines(spark: SparkSession, folder: str) -> DataFrame:
    parents = table(spark, folder, "orders").where(F.col("o_orderpriority") != "1-URGENT")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return orphans(lines, "l_orderkey", parents, "o_orderkey")


def line_count_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumn("lines", F.lit(4).cast("bigint"))
    return count_mismatches(orders, "o_orderkey", "lines", table(spark, folder, "lineitem"), "l_orderkey")


def default_preferences(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    preferences = table(spark, folder, "region").select(long("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    pid = F.when(F.col("o_orderstatus") == "P", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    existing = table(spark, folder, "orders").select(long(pid).alias("pid"), F.col("o_custkey").alias("uid"))
    return insert_default_if_absent(users, preferences, existing, "ASIA", "500")


def _optimistic(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderpriority", long(F.when(F.col("o_orderstatus") == "P", 2).otherwise(1)).alias("version")
    )
    changes = table(spark, folder, "events").select(
        (F.col("user_id") * 150).alias("o_orderkey"),
        long(F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)).alias("version"),
        "event_id",
        F.col("event_type").alias("o_orderpriority"),
    )
    return optimistic_update(base, changes, "o_orderkey", "version", "event_id", ["o_orderpriority"])


def optimistic_table(spark: SparkSession, folder: str) -> DataFrame:
    return _optimistic(spark, folder)[0]


def optimistic_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _optimistic(spark, folder)[1]


def numbered_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return assign_seq(orders, "seq", ["o_totalprice", "o_orderkey"], start=101)


def appended_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Two appends to one table: ids go on where the first append ended."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    path = work_folder(spark, "append")
    append_rows(orders.where("o_orderstatus = 'F'"), path, order_by=["o_orderkey"], keys=["o_orderkey"])
    append_rows(orders.where("o_orderstatus <> 'F'"), path, order_by=["o_orderkey"], keys=["o_orderkey"])
    return spark.read.parquet(path)


def key_violations(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.nullif("l_linenumber", F.lit(7)).alias("l_linenumber"))
    found = pk_violations(lines, ["l_orderkey", "l_linenumber"])
    return found.select("l_orderkey", long("l_linenumber").alias("l_linenumber"), "n", "problem")


def stored_key_violations(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey")
    stored = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return pk_violations(customers, ["c_custkey"], stored)


def declared_customers(spark: SparkSession, folder: str) -> DataFrame:
    schema = declare_schema(
        "customers", '{"c_custkey": "seqnumber", "c_name": "String", "c_acctbal": "NUMBER", "note": "string"}', ["c_custkey"]
    )
    rows = conform(table(spark, folder, "customer"), schema)
    return rows.withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


def latest_events(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return latest_by_key(events, ["user_id"], "event_id")


def created_users(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type")
    existing = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return idempotent_add(events, existing, ["user_id"], "event_id")


def top_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    best = top_k_per_query(orders, "o_custkey", [F.col("o_totalprice").desc(), "o_orderkey"], 3)
    return best.withColumn("rank", long("rank"))


def first_names(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every page in the order of case-folded addresses."""
    return assign_seq(table(spark, folder, "pages").select("page_id", "url"), "place", name_columns("url", "page_id"))


_STATE = "nullif(o_orderstatus, 'P')"
_WORDS = r"regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')"
_OPT = """WITH base AS (SELECT o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'P' THEN 2 ELSE 1 END::BIGINT AS version FROM orders),
c AS (SELECT user_id * 150 AS o_orderkey, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END::BIGINT AS version,
  event_id, event_type FROM events),
w AS (SELECT o_orderkey, min(event_id) AS win, arg_min(event_type, event_id) AS new FROM c JOIN base USING (o_orderkey, version) GROUP BY o_orderkey)
"""

QUERIES = {
    "table_filter_page": (
        table_filter_page,
        """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""",
    ),
    "filter_operators": (
        filter_operators,
        """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')
        AND o_orderstatus <> 'F' AND o_totalprice >= 1000.5 AND o_totalprice < 400000 AND o_orderkey <= 1000000000 AND o_custkey IS NOT NULL""",
    ),
    "null_filter": (null_filter, f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {_STATE} IS NULL"),
    "open_status_filter": (open_orders, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'"),
    "null_order": (
        null_order,
        f"""SELECT o_orderkey, {_STATE} AS state, 'desc' AS sort,
          row_number() OVER (ORDER BY {_STATE} DESC NULLS FIRST, o_orderkey) AS place FROM orders
        UNION ALL SELECT o_orderkey, {_STATE} AS state, 'asc' AS sort,
          row_number() OVER (ORDER BY {_STATE} ASC NULLS LAST, o_orderkey DESC) AS place FROM orders""",
    ),
    "page_rows": (
        orders_page, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50"
    ),
    "page_deep": (
        orders_deep_page, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 750"
    ),
    "page_envelope": (
        orders_envelope,
        """SELECT count(*) AS total, greatest(0, least(25, count(*) - 50))::BIGINT AS count, 25::BIGINT AS "pageSize",
        3::BIGINT AS "offset" FROM orders""",
    ),
    "like_lookup": (like_lookup, "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#%7%'"),
    "ilike_lookup": (ilike_lookup, "SELECT doc_id, lang FROM documents WHERE text ILIKE '%TION the%'"),
    "fts_lookup": (
        fts_lookup,
        f"SELECT doc_id, lang FROM documents WHERE list_contains({_WORDS}, 'the') AND list_contains({_WORDS}, 'and')",
    ),
    "fts_postings": (
        fts_by_postings,
        f"SELECT doc_id, lang FROM documents WHERE list_contains({_WORDS}, 'the') AND list_contains({_WORDS}, 'and')",
    ),
    "update_where": (
        update_orders,
        """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN '0-NONE' ELSE o_orderpriority END AS o_orderpriority,
        o_totalprice + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS o_totalprice FROM orders""",
    ),
    "delete_where": (delete_orders, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'"),
    "cascade_delete": (
        cascade_lines,
        """SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
    ),
    "orphans": (
        orphan_lines,
        """SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT')""",
    ),
    "count_mismatches": (
        line_count_mismatches,
        """SELECT o_orderkey, 4::BIGINT AS declared, count(l_orderkey) AS stored FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
        GROUP BY o_orderkey HAVING count(l_orderkey) <> 4""",
    ),
    "insert_default_if_absent": (
        default_preferences,
        """SELECT 2::BIGINT AS pid, c_custkey AS uid, '500' AS value FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
    ),
    "optimistic_update": (
        optimistic_table,
        _OPT + """SELECT o_orderkey, coalesce(new, o_orderpriority) AS o_orderpriority,
        version + CASE WHEN win IS NULL THEN 0 ELSE 1 END AS version FROM base LEFT JOIN w USING (o_orderkey)""",
    ),
    "optimistic_outcomes": (
        optimistic_outcomes,
        _OPT + """SELECT c.o_orderkey, event_id, CASE WHEN base.version IS NULL THEN 'missing' WHEN win = event_id THEN 'applied'
        ELSE 'conflict' END AS outcome, base.version AS current_version
        FROM c LEFT JOIN base USING (o_orderkey) LEFT JOIN w USING (o_orderkey)""",
    ),
    "assign_seq": (
        numbered_orders,
        "SELECT 100 + row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS seq, o_orderkey, o_totalprice FROM orders",
    ),
    "append_rows": (
        appended_orders,
        """SELECT row_number() OVER (ORDER BY o_orderstatus <> 'F', o_orderkey) AS id, o_orderkey, o_orderstatus FROM orders""",
    ),
    "pk_violations": (
        key_violations,
        """WITH l AS (SELECT l_orderkey, nullif(l_linenumber, 7)::BIGINT AS l_linenumber FROM lineitem)
        SELECT l_orderkey, l_linenumber, count(*) AS n, CASE WHEN l_linenumber IS NULL THEN 'null' ELSE 'duplicate' END AS problem
        FROM l GROUP BY 1, 2 HAVING count(*) > 1 OR l_linenumber IS NULL""",
    ),
    "pk_exists": (
        stored_key_violations,
        """SELECT c_custkey, 1::BIGINT AS n, 'exists' AS problem FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""",
    ),
    "declared_schema": (
        declared_customers, "SELECT c_custkey, c_name, c_acctbal, NULL::VARCHAR AS note FROM customer"
    ),
    "latest_by_key": (
        latest_events,
        """SELECT event_id, user_id, event_type, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    ),
    "idempotent_add": (
        created_users,
        """SELECT event_id, user_id, event_type FROM events
        WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""",
    ),
    "top_k_per_key": (
        top_orders,
        """SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
        FROM orders QUALIFY rank <= 3""",
    ),
    "name_order": (first_names, "SELECT page_id, url, row_number() OVER (ORDER BY lower(url), url, page_id) AS place FROM pages"),
}
