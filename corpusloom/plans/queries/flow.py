"""Flow queries over events, in batch and as streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions.retry import retry_class, retry_wait
from corpusloom.operators.flow import (
    dead_letter, expire, fan_out, retry_rounds, route, route_conservation, set_attributes, unexpired,
)
from corpusloom.plans.queries.common import long, table
from corpusloom.session import work_folder
from corpusloom.streaming.flows import (
    dead_letter_stream, distinct_stream, fan_out_stream, folder_sink, record_stream, retry_stream, route_stream,
)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


def _rules() -> dict:
    return {
        "errors": F.col("event_type") == "error",
        "large": F.col("value") > 100,
        "sales": F.col("event_type") == "purchase",
    }


def routed(spark: SparkSession, folder: str) -> DataFrame:
    return route(events(spark, folder), _rules()).select("event_id", "route")


def routed_to_all(spark: SparkSession, folder: str) -> DataFrame:
    return route(events(spark, folder), _rules(), to_all=True).select("event_id", "route")


def route_counts(spark: SparkSession, folder: str) -> DataFrame:
    all_events = events(spark, folder)
    return route_conservation(route(all_events, _rules()), list(_rules()))


def fanned_out(spark: SparkSession, folder: str) -> DataFrame:
    """Two sinks get all events; their rows are read back."""
    path = work_folder(spark, "fan")
    fan_out(
        events(spark, folder).select("event_id", "event_type"),
        {
            "store": lambda df: df.write.parquet(f"{path}/store"),
            "audit": lambda df: df.write.json(f"{path}/audit"),
        },
    )
    stored = spark.read.parquet(f"{path}/store").withColumn("sink", F.lit("store"))
    audit = spark.read.schema("event_id bigint, event_type string").json(f"{path}/audit").withColumn("sink", F.lit("audit"))
    return stored.unionByName(audit)


def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    path = work_folder(spark, "dead")
    ended = events(spark, folder).select(
        "event_id", F.when(F.col("event_type") == "error", "failure").when(F.col("value") > 100, "no retry").otherwise("original").alias("relationship")
    )
    dead_letter(ended, "relationship", path)
    return spark.read.schema("event_id bigint, relationship string").parquet(path)


def _ended(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("value") > 100, "no retry").otherwise("original")
    return df.select("event_id", "ts", kind.alias("relationship"))


_QUEUE = "event_id bigint, ts timestamp_ntz, relationship string, ended_on date"


def dead_letter_days(spark: SparkSession, folder: str) -> DataFrame:
    """A terminal queue divided by days: the records that have not expired, from their days alone."""
    path = work_folder(spark, "dead")
    dead_letter(_ended(events(spark, folder)), "relationship", path, "ts")
    queue = spark.read.schema(_QUEUE).parquet(path)
    return unexpired(queue, "ts", datetime(2024, 2, 1), "10 days").select("event_id", "relationship")


def stream_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """The same queue filled by a stream."""
    path = work_folder(spark, "stream-dead")
    dead_letter_stream(_ended(_stream(spark, folder)), "relationship", "ts", f"{path}/out", f"{path}/checkpoint").awaitTermination()
    queue = spark.read.schema(_QUEUE).parquet(f"{path}/out")
    return unexpired(queue, "ts", datetime(2024, 2, 1), "10 days").select("event_id", "relationship")


def fresh_events(spark: SparkSession, folder: str) -> DataFrame:
    return expire(events(spark, folder), "ts", datetime(2024, 4, 20)).select("event_id")


def fresh_for_a_week(spark: SparkSession, folder: str) -> DataFrame:
    all_events = events(spark, folder)
    now = all_events.agg(F.max("ts")).scalar()
    return expire(all_events, "ts", now, "7 days").select("event_id")


def _answers(df: DataFrame) -> DataFrame:
    """Each event as an answer of a service; which one depends on the event."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = (
        F.when(k < 10, 400).when(k < 20, 429).when(k < 30, 503).when(k < 40, F.lit(None)).when(k < 50, 401).otherwise(200)
    )
    return df.select(
        "event_id",
        (F.floor(F.col("value") / 50) + 1).cast("int").alias("attempt"),
        status.alias("status"),
        F.when(k.between(15, 19), "insufficient_quota").alias("error_code"),
        F.when(k.between(20, 24), "45").when(k.between(25, 27), "soon").alias("retry_after"),
    )


def retry_plan(spark: SparkSession, folder: str) -> DataFrame:
    answers = _answers(events(spark, folder))
    attempt, status = F.col("attempt"), F.col("status")
    kind = retry_class(attempt, status, F.col("error_code"))
    wait = retry_wait(attempt, status, F.col("retry_after"))
    return answers.select(
        "event_id", long("attempt").alias("attempt"), kind.alias("kind"), F.when(kind == "retry", wait).alias("wait_s")
    )


def _service(df: DataFrame) -> DataFrame:
    """A service that fails for a time which depends on the event, or for good."""
    k = F.get_json_object("props", "$.k").cast("int")
    return df.withColumn(
        "status", F.when(k < 10, 400).when(F.col("attempt") > F.floor(k / 11), 200).otherwise(503)
    )


def retried(spark: SparkSession, folder: str) -> DataFrame:
    found = retry_rounds(events(spark, folder).select("event_id", "props"), _service)
    return found.select("event_id", long("attempt").alias("attempt"), "outcome")


def attributes(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "pages").select(
        "page_id", F.create_map(F.lit("filename"), F.lit("old"), F.lit("host"), F.parse_url("url", F.lit("HOST"))).alias("attributes"), "url"
    )
    named = set_attributes(
        records,
        {"filename": F.regexp_extract("url", "([^/]*)$", 1), "absolute.path": F.regexp_replace("url", "/[^/]*$", "")},
    )
    pick = lambda name: F.try_element_at("attributes", F.lit(name))
    return named.select(
        "page_id", pick("filename").alias("filename"), pick("absolute.path").alias("path"), pick("host").alias("host"),
        long(F.size("attributes")).alias("n"),
    )


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return record_stream(spark, folder, schema, "events.parquet")


def stream_routes(spark: SparkSession, folder: str) -> DataFrame:
    path = work_folder(spark, "stream-route")
    query = route_stream(_stream(spark, folder), _rules(), f"{path}/out", f"{path}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", "route")


def stream_sinks(spark: SparkSession, folder: str) -> DataFrame:
    path = work_folder(spark, "stream-fan")
    stream = _stream(spark, folder).select("event_id", "event_type")
    sinks = {"store": folder_sink(f"{path}/store"), "audit": folder_sink(f"{path}/audit", "event_type")}
    fan_out_stream(stream, sinks, f"{path}/checkpoint").awaitTermination()
    read = lambda name: spark.read.parquet(f"{path}/{name}").select("event_id", "event_type", F.lit(name).alias("sink"))
    return read("store").unionByName(read("audit"))


def stream_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Users and event types seen in the stream, each once."""
    path = work_folder(spark, "stream-distinct")
    stream = _stream(spark, folder).select("ts", "user_id", "event_type")
    first = distinct_stream(stream, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type")
    query = (
        first.writeStream.format("parquet").option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def stream_retries(spark: SparkSession, folder: str) -> DataFrame:
    """One pass of the streaming retry loop: where each event went."""
    path = work_folder(spark, "stream-retry")
    work = _stream(spark, folder).select("event_id", "props", F.lit(1).alias("attempt"))
    query = retry_stream(
        work, _service, f"{path}/retry", folder_sink(f"{path}/done"), folder_sink(f"{path}/ended"), f"{path}/checkpoint"
    )
    query.awaitTermination()
    read = lambda name: spark.read.parquet(f"{path}/{name}").select(
        "event_id", long("attempt").alias("attempt"), "outcome", F.lit(name).alias("sink")
    )
    return read("retry").unionByName(read("done")).unionByName(read("ended"))


_ROUTE = """CASE WHEN event_type = 'error' THEN 'errors' WHEN value > 100 THEN 'large' WHEN event_type = 'purchase' THEN 'sales'
 ELSE 'unmatched' END"""
_K = "(props->>'$.k')::INT"
_KIND = """CASE WHEN status = 200 THEN 'success' WHEN error_code OR status IN (400, 401) THEN 'permanent'
 WHEN attempt > 6 THEN 'exhausted' ELSE 'retry' END"""
_SINKS = " UNION ALL ".join(f"SELECT event_id, event_type, '{sink}' AS sink FROM events" for sink in ("store", "audit"))

_FRESH = """SELECT event_id, CASE WHEN event_type = 'error' THEN 'failure' WHEN value > 100 THEN 'no retry' ELSE 'original' END
 AS relationship FROM events WHERE ts > TIMESTAMP '2024-02-01' - INTERVAL 10 DAY"""

QUERIES = {
    "route_events": (routed, f"SELECT event_id, {_ROUTE} AS route FROM events"),
    "route_to_all": (
        routed_to_all,
        """SELECT event_id, 'errors' AS route FROM events WHERE event_type = 'error'
        UNION ALL SELECT event_id, 'large' FROM events WHERE value > 100
        UNION ALL SELECT event_id, 'sales' FROM events WHERE event_type = 'purchase'
        UNION ALL SELECT event_id, 'unmatched' FROM events WHERE event_type NOT IN ('error', 'purchase') AND value <= 100""",
    ),
    "route_conservation": (
        route_counts,
        f"SELECT 'input' AS name, count(*) AS n FROM events UNION ALL SELECT {_ROUTE} AS name, count(*) AS n FROM events GROUP BY 1",
    ),
    "fan_out": (fanned_out, _SINKS),
    "dead_letter": (
        dead_letters,
        """SELECT event_id, CASE WHEN event_type = 'error' THEN 'failure' WHEN value > 100 THEN 'no retry' ELSE 'original' END
        AS relationship FROM events""",
    ),
    "dead_letter_days": (dead_letter_days, _FRESH),
    "stream_dead_letter": (stream_dead_letters, _FRESH),
    "expire_events": (fresh_events, "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-04-20' - INTERVAL 100 DAY"),
    "expire_after_a_week": (
        fresh_for_a_week, "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY"
    ),
    "retry_plan": (
        retry_plan,
        f"""WITH a AS (SELECT event_id, {_K} AS k, floor(value / 50)::BIGINT + 1 AS attempt FROM events),
        s AS (SELECT *, CASE WHEN k < 10 THEN 400 WHEN k < 20 THEN 429 WHEN k < 30 THEN 503 WHEN k < 40 THEN NULL WHEN k < 50 THEN 401 ELSE 200 END AS status,
          k BETWEEN 15 AND 19 AS error_code, CASE WHEN k BETWEEN 20 AND 24 THEN 45.0 END AS after FROM a),
        c AS (SELECT *, {_KIND} AS kind FROM s)
        SELECT event_id, attempt, kind, CASE WHEN kind = 'retry' THEN
          greatest(least(2.0 * pow(2, attempt - 1), 60), coalesce(after, 0))::DOUBLE END AS wait_s FROM c""",
    ),
    "retry_rounds": (
        retried,
        f"""WITH a AS (SELECT event_id, {_K} AS k FROM events)
        SELECT event_id, CASE WHEN k < 10 THEN 1 ELSE least(k // 11 + 1, 7) END::BIGINT AS attempt,
        CASE WHEN k < 10 THEN 'permanent' WHEN k // 11 >= 7 THEN 'exhausted' ELSE 'success' END AS outcome FROM a""",
    ),
    "set_attributes": (
        attributes,
        """SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS filename, regexp_replace(url, '/[^/]*$', '') AS path,
        regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, 3::BIGINT AS n FROM pages""",
    ),
    "stream_route": (stream_routes, f"SELECT event_id, {_ROUTE} AS route FROM events"),
    "stream_fan_out": (stream_sinks, _SINKS),
    "stream_distinct": (stream_distinct, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_retry": (
        stream_retries,
        f"""WITH a AS (SELECT event_id, {_K} AS k FROM events)
        SELECT event_id, CASE WHEN k >= 11 THEN 2 ELSE 1 END::BIGINT AS attempt,
        CASE WHEN k < 10 THEN 'permanent' WHEN k < 11 THEN 'success' ELSE 'retry' END AS outcome,
        CASE WHEN k < 10 THEN 'ended' WHEN k < 11 THEN 'done' ELSE 'retry' END AS sink FROM a""",
    ),
}
