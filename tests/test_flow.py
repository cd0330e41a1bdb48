from __future__ import annotations

import json
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusloom.functions import deploy as L, documents as K, retry as R
from corpusloom.operators import flow as J, stats as D
from corpusloom.streaming import flows as ST

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def records(spark):
    rows = [(1, "a", 5.0), (2, "b", 50.0), (3, None, 500.0), (4, "a", None)]
    return spark.createDataFrame(rows, "id bigint, kind string, v double")


def rules():
    return {"as": F.col("kind") == "a", "big": F.col("v") > 10}


def test_route_and_conservation(spark):
    df = records(spark)
    routed = J.route(df, rules())
    assert {r.id: r.route for r in routed.collect()} == {1: "as", 2: "big", 3: "big", 4: "as"}
    frames = J.route_frames(routed, ["as", "big"])
    counts = {r.name: r.n for r in J.conservation(df, frames).collect()}
    assert counts["input"] == sum(n for name, n in counts.items() if name != "input")
    nothing = J.route(df, {"none": F.col("v") < 0}, unmatched="rest")
    assert {r.route for r in nothing.collect()} == {"rest"}
    everything = J.route(df.withColumn("kind", F.lit("a")), rules(), to_all=True)
    assert sorted((r.id, r.route) for r in everything.collect()) == [(1, "as"), (2, "as"), (2, "big"), (3, "as"), (3, "big"), (4, "as")]
    with pytest.raises(ValueError):
        J.route(df, {"unmatched": F.lit(True)})


def test_dead_letters_have_their_own_folders(spark, tmp_path):
    path = str(tmp_path / "dead")
    J.dead_letter(J.route(records(spark), rules()), "route", path)
    J.dead_letter(J.route(records(spark), rules()), "route", path)
    assert sorted(p.name for p in (tmp_path / "dead").glob("route=*")) == ["route=as", "route=big"]
    assert spark.read.parquet(path).count() == 8


def test_expire(spark):
    df = spark.createDataFrame(
        [(1, datetime(2024, 1, 1)), (2, datetime(2024, 4, 1)), (3, None)], "id int, ts timestamp_ntz"
    )
    ids = lambda **kw: [r.id for r in J.expire(df, "ts", datetime(2024, 4, 20), **kw).orderBy("id").collect()]
    assert ids() == [2, 3] and ids(ttl="1 day") == [3] and ids(ttl="1 year") == [1, 2, 3]


def test_attributes(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},), (None,)], "attributes map<string,string>")
    rows = J.set_attributes(df, {"b": F.lit(7), "c": F.lit("x")}).collect()
    assert [r.attributes for r in rows] == [{"a": "1", "b": "7", "c": "x"}, {"b": "7", "c": "x"}]


def test_retry_rules(spark):
    rows = [(n, s, c, a) for n in (1, 2, 5, 6, 7) for s in (200, 400, 401, 429, 503, None) for c in (None, "insufficient_quota") for a in (None, "90", "3", "x")]
    df = spark.createDataFrame(rows, "n int, s int, c string, a string")

    def kind(n, s, c):
        if s == 200:
            return "success"
        if c or s in (400, 401):
            return "permanent"
        return "exhausted" if n > 6 else "retry"

    def wait(n, s, a):
        base = min(2.0 * 2 ** (n - 1), 60.0)
        return max(base, float(a)) if a in ("90", "3") and s is not None else base

    n, s = F.col("n"), F.col("s")
    for row in df.select("*", R.retry_class(n, s, F.col("c")).alias("k"), R.retry_wait(n, s, F.col("a")).alias("w")).collect():
        assert row.k == kind(row.n, row.s, row.c), row
        assert row.w == wait(row.n, row.s, row.a), row
    assert [R.backoff_seconds(i) for i in range(1, 8)] == [2, 4, 8, 16, 32, 60, 60]


def test_retry_rounds(spark):
    step = lambda df: df.withColumn("status", F.when(F.col("id") == 2, 400).when(F.col("attempt") >= F.col("id"), 200).otherwise(503))
    df = spark.createDataFrame([(1,), (2,), (3,), (9,)], "id int")
    found = {r.id: (r.attempt, r.outcome) for r in J.retry_rounds(df, step).collect()}
    assert found == {1: (1, "success"), 2: (1, "permanent"), 3: (3, "success"), 9: (7, "exhausted")}


@pytest.mark.parametrize("retries", [0, 1, 2, 8])
def test_retries_lose_no_record(spark, retries):
    step = lambda df: df.withColumn("status", F.when(F.col("attempt") >= F.col("id"), 200).otherwise(503))
    found = J.retry_rounds(spark.range(1, 11), step, retries).collect()
    assert sorted(r.id for r in found) == list(range(1, 11))
    assert {r.id: r.outcome for r in found} == {i: "success" if i <= retries + 1 else "exhausted" for i in range(1, 11)}


def test_fan_out_gives_all_records_to_all_sinks(spark):
    seen = {}
    J.fan_out(records(spark), {name: (lambda df, name=name: seen.update({name: df.count()})) for name in ("x", "y")})
    assert seen == {"x": 4, "y": 4}


def test_streams_equal_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = records(spark)
    df.write.parquet(folder)
    stream = ST.record_stream(spark, folder, df.schema)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    ST.route_stream(stream, rules(), out, check).awaitTermination()
    batch = {(r.id, r.route) for r in J.route(df, rules()).collect()}
    read = lambda: [(r.id, r.route) for r in spark.read.parquet(out).collect()]
    assert set(read()) == batch
    ST.route_stream(stream, rules(), out, check).awaitTermination()
    assert len(read()) == 4  # a second start finds nothing new
    df.limit(1).write.mode("append").parquet(folder)
    ST.route_stream(stream, rules(), out, check).awaitTermination()
    assert len(read()) == 5


def test_stream_retry_feeds_the_retry_table(spark, tmp_path):
    """Three passes: the retry table of one pass is the input of the next."""
    step = lambda df: df.withColumn("status", F.when(F.col("attempt") >= F.col("id"), 200).otherwise(503))
    source = str(tmp_path / "p0")
    spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id int, attempt int").write.parquet(source)
    schema = spark.read.parquet(source).schema
    for n in range(3):
        stream = (
            spark.readStream.schema(schema).option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet").parquet(source)
        )
        target = str(tmp_path / f"p{n + 1}")
        ST.retry_stream(
            stream, step, target, ST.folder_sink(str(tmp_path / f"done{n}")), ST.folder_sink(str(tmp_path / f"ended{n}")),
            str(tmp_path / f"check{n}"),
        ).awaitTermination()
        done = [(r.id, r.attempt) for r in spark.read.parquet(str(tmp_path / f"done{n}")).collect()]
        assert done == [(n + 1, n + 1)]
        source = target
    assert spark.read.parquet(source).count() == 0


def test_stream_retry_waits(spark, tmp_path):
    """A record that is not due goes back to the retry table as it is; a due one is tried."""
    now = datetime(2024, 1, 1, 12)
    rows = [(1, 2, datetime(2024, 1, 1, 11)), (2, 2, datetime(2024, 1, 1, 13)), (3, 2, None)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "id int, attempt int, not_before timestamp").write.parquet(source)
    step = lambda df: df.withColumn("status", F.when(F.col("id") == 1, 200).otherwise(503))
    path = lambda name: str(tmp_path / name)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    ST.retry_stream(
        stream, step, path("retry"), ST.folder_sink(path("done")), ST.folder_sink(path("ended")), path("check"), F.lit(now)
    ).awaitTermination()
    assert [r.id for r in spark.read.parquet(path("done")).collect()] == [1]
    found = {r.id: (r.attempt, r.not_before) for r in spark.read.parquet(path("retry")).collect()}
    assert found == {2: (2, datetime(2024, 1, 1, 13)), 3: (3, datetime(2024, 1, 1, 12, 0, 4))}


def test_file_attributes(spark):
    df = spark.createDataFrame([("file:/a/b/c.pdf",)], "path string")
    assert ST.file_attributes(df).first().attributes == {"absolute.path": "file:/a/b", "filename": "c.pdf"}


def test_report(spark):
    rows = [("succeeded", "b", None), ("parse_failed", "A", "x"), ("skipped", "c", "y")]
    df = spark.createDataFrame(rows, "status string, file string, detail string")
    assert tuple(D.run_report(df).first()) == (1, 1, 1, 0, True)
    assert D.run_report(df.where("status <> 'succeeded'")).first().success  # all that was parsed was skipped
    assert not D.run_report(df.where("status = 'parse_failed'")).first().success
    assert tuple(D.run_report(df.limit(0)).first()) == (0, 0, 0, 0, False)
    assert [r.status for r in D.outcome_rows(df).collect()] == ["parse_failed", "skipped", "succeeded"]


def test_metadata_and_json(spark):
    df = spark.createDataFrame([('{"m": "x", "n": 3}',), ("{}",)], "j string").withColumn("v", F.parse_json("j"))
    for column in ("j", "v"):
        rows = df.select(K.metadata_get(df, column, "$.m").alias("m"), K.metadata_get(df, column, "$.n", "int").alias("n")).collect()
        assert [tuple(r) for r in rows] == [("x", 3), (None, None)]
    built = spark.createDataFrame([(1, None, "drop")], "a int, b string, c string")
    text = built.select(K.json_build(built, ["c"], {"distance": F.lit(0.5)}).alias("o")).first().o
    assert json.loads(text) == {"a": 1, "b": None, "distance": 0.5}
    empty = spark.createDataFrame([], "id int, o string")
    assert K.json_array(empty, [F.col("id")], F.col("o")).first().result == "[]"
    some = spark.createDataFrame([(2, '{"x":2}'), (1, '{"x":1}')], "id int, o string")
    assert json.loads(K.json_array(some, [F.col("id")], F.col("o")).first().result) == [{"x": 1}, {"x": 2}]
    pairs = K.json_each_text(spark.createDataFrame([('{"b": 1, "a": "t", "n": null, "o": {"k": 2}}',), ("{}",)], "j string"), "j")
    assert [(r.pos, r.key, r.value) for r in pairs.orderBy("pos").collect()] == [
        (0, "b", "1"), (1, "a", "t"), (2, "n", None), (3, "o", '{"k":2}'),
    ]


def test_xml_in_any_namespace(spark):
    xml = '<d:m xmlns:d="DAV:"><d:href>/a%20b</d:href><x><href>/c</href></x><d:hrefs>no</d:hrefs></d:m>'
    df = spark.createDataFrame([(xml,)], "x string")
    assert df.select(K.xml_values(F.col("x"), "href").alias("v")).first().v == ["/a%20b", "/c"]
    with pytest.raises(ValueError):
        K.xml_values(F.col("x"), "a' or '1")


def test_hal_documents(spark):
    docs = [
        '{"total": 2, "count": 1, "pageSize": 1, "offset": 2, "_embedded": {"elements": [{"id": 5, "subject": "s", "_links": {"status": {"title": "New"}}}]}}',
        '{"_type": "Error", "errorIdentifier": "urn:x", "message": "stale"}',
    ]
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    assert [tuple(r) for r in K.hal_elements(df, "doc").collect()] == [(5, "s", "New")]
    assert tuple(df.select(K.hal_page(F.col("doc")).alias("p")).first().p) == (2, 1, 1, 2)
    errors = df.select(K.hal_error(F.col("doc"), F.lit(409)).alias("e")).collect()
    assert [tuple(r.e) for r in errors] == [(False, None, None, None), (True, "urn:x", "stale", "refetch")]


def test_deploy_and_call(spark):
    made = L.deploy_function(spark, "add_tax", "price * (1 + rate)", "price DOUBLE, rate DOUBLE", "DOUBLE").first()
    assert made.success and made.function_name == "add_tax" and made.created_at is not None
    assert L.call_function(spark, "add_tax", price=10.0, rate=0.5).first().result == 15.0
    again = L.deploy_function(spark, "add_tax", "price", "price DOUBLE, rate DOUBLE", "DOUBLE", replace=False).first()
    assert not again.success and "already exists" in again.error
    for kwargs in ({"name": "Bad-Name"}, {"language": "plpgsql"}, {"body": "no such thing ("}):
        failed = L.deploy_function(spark, **{"name": "f", "body": "1", "return_type": "INT", **kwargs}).first()
        assert not failed.success and failed.error
    table = L.deploy_function(spark, "up_to", "SELECT id FROM range(10) WHERE id < n", "n INT", "TABLE(id BIGINT)").first()
    assert table.success, table.error
    assert L.call_table_function(spark, "up_to", n=3).count() == 3
