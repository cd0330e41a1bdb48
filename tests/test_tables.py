from __future__ import annotations

import pytest
from pyspark.sql import functions as F, types as T

from corpusloom.operators import keys as K, tables as B
from corpusloom.sources import schema as A


def test_declared_schema():
    made = A.declare_schema("t", '{"id": "SeqNumber", "s": "string", "n": "number", "d": "datetime", "v": "vector", "j": "jsonb"}', ["id"], dims=8)
    assert made.fieldNames() == ["id", "s", "n", "d", "v", "j"]
    assert [f.dataType.simpleString() for f in made.fields] == [
        "bigint", "string", "decimal(38,18)", "timestamp_ntz", "array<float>", "variant",
    ]
    assert made["v"].metadata["dims"] == 8 and A.primary_key(made) == ["id"]


@pytest.mark.parametrize(
    "table,columns,key,text",
    [
        (" ", {"a": "string"}, [], "Table name"),
        (None, {"a": "string"}, [], "Table name"),
        ("t", "[1]", [], "JSON object"),
        ("t", None, [], "JSON object"),
        ("t", {"a": "text"}, [], 'Unsupported type "text" for column "a"'),
        ("t", {"a": "string"}, ["b"], '"b"'),
    ],
)
def test_declared_schema_errors(table, columns, key, text):
    with pytest.raises(ValueError, match=text):
        A.declare_schema(table, columns, key)


def test_create_table_and_preflight(spark):
    spark.sql("DROP TABLE IF EXISTS made_documents")
    columns = {"id": "seqnumber", "filename": "string", "metadata": "jsonb", "embedding": "vector"}
    A.create_table(spark, " made_documents ", columns, ["id"])
    with pytest.raises(Exception, match="already exists"):
        A.create_table(spark, "made_documents", columns)
    required = {
        "made_documents": A.declare_schema("d", {**columns, "extra": "string", "filename": "number"}),
        "made_chunks": A.declare_schema("c", {"id": "seqnumber"}),
    }
    found = A.preflight(spark, required, A.catalog_schemas(spark, list(required))).collect()
    assert {(r.table, r.column): r.problem for r in found} == {
        ("made_documents", "extra"): "missing column",
        ("made_documents", "filename"): "type is string",
        ("made_chunks", "id"): "missing table",
    }
    row = spark.createDataFrame([(1, "a", '{"x": 1}')], "id bigint, filename string, m string")
    stored = A.conform(row.withColumn("metadata", F.parse_json("m")), A.declare_schema("d", columns))
    stored.write.mode("append").format("parquet").saveAsTable("made_documents")
    assert spark.table("made_documents").select(F.variant_get("metadata", "$.x", "int")).first()[0] == 1
    spark.sql("DROP TABLE made_documents")


def test_filters(spark):
    rows = [(1, "a_b", 2.5, True), (2, "aXb", None, False), (3, None, 1.0, None), (4, "A%B\\c*", 9.0, True)]
    df = spark.createDataFrame(rows, "id bigint, s string, n double, ok boolean")
    ids = lambda *specs, **kw: sorted(
        r.id for r in B.apply_filters(df, [{f: {"operator": o, "values": list(v)}} for f, o, *v in specs], **kw).collect()
    )
    assert ids(("id", "eq", "2")) == [2]
    assert ids(("n", "neq", 2.5)) == [3, 4]
    assert ids(("n", "gt", "1"), ("n", "lte", 9)) == [1, 4]
    assert ids(("id", "in", "1", 4)) == [1, 4]
    assert ids(("n", "is", "null")) == [2] and ids(("ok", "is", "true")) == [1, 4]
    assert ids(("s", "like", "a_*")) == [1]
    assert ids(("s", "ilike", "a%*")) == [4]
    assert ids(("s", "like", "*\\c*")) == [4]
    assert ids(("n", "not_null")) == [1, 3, 4]
    assert ids(("s", "o"), open_statuses=spark.createDataFrame([("aXb",), ("zz",)], "name string")) == [2]
    with pytest.raises(ValueError):
        ids(("s", "near", "x"))


def test_fts(spark):
    texts = ["The quick fox", "thequick fox", "Über quick, the", "a.b c++ the", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    hits = lambda *terms: [r.id for r in df.where(B.fts(F.col("t"), list(terms))).orderBy("id").collect()]
    assert hits("THE", "quick") == [0, 2]
    assert hits("über") == [2]
    assert hits("a.b") == [3]


def test_order_and_page(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a"), (4, None)], "id bigint, s string")
    ids = lambda *order, **kw: [r.id for r in B.read_table(df, order=list(order), **kw).collect()]
    assert ids(("s", "asc"), ("id", "asc")) == [3, 2, 1, 4]
    assert ids(("s", "desc"), ("id", "desc")) == [4, 1, 2, 3]
    assert ids(("id", "asc"), limit=0) == []
    assert [r.id for r in B.page(df, 2, 3, [("id", "asc")]).collect()] == [4]
    envelope = lambda no, size: tuple(B.page_envelope(df, no, size).first())
    assert envelope(1, 3) == (4, 3, 3, 1) and envelope(2, 3) == (4, 1, 3, 2) and envelope(9, 3) == (4, 0, 3, 9)
    with pytest.raises(ValueError):
        B.page(df, 0, 3, [("id", "asc")])


def test_update_delete_keep_null_predicates(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id bigint, s string")
    updated = B.update_where(df, F.col("s") == "x", {"id": F.col("id") * 10, "s": "z"})
    assert sorted(map(tuple, updated.collect()), key=lambda r: r[0]) == [(2, None), (3, "y"), (10, "z")]
    assert sorted(r.id for r in B.delete_where(df, F.col("s") == "x").collect()) == [2, 3]


def test_default_preferences_are_idempotent(spark):
    users = spark.createDataFrame([(1,), (2,)], "id bigint")
    prefs = spark.createDataFrame([(7, "size"), (5, "size"), (1, "other")], "id bigint, name string")
    have = spark.createDataFrame([(5, 1, "9")], "pid bigint, uid bigint, value string")
    added = B.insert_default_if_absent(users, prefs, have, "size", "500")
    assert [tuple(r) for r in added.collect()] == [(5, 2, "500")]
    assert B.insert_default_if_absent(users, prefs, have.unionByName(added), "size", "500").count() == 0
    assert B.insert_default_if_absent(users, prefs, have, "absent", "500").count() == 0


def test_optimistic_update(spark):
    base = spark.createDataFrame([(1, 3, "a"), (2, 1, "b")], "id bigint, version bigint, s string")
    changes = spark.createDataFrame(
        [(10, 1, 3, "x"), (11, 1, 3, "y"), (12, 2, 9, "z"), (13, 5, 1, "w")], "seq bigint, id bigint, version bigint, s string"
    )
    updated, outcomes = B.optimistic_update(base, changes, "id", "version", "seq", ["s"])
    assert sorted(tuple(r) for r in updated.collect()) == [(1, 4, "x"), (2, 1, "b")]
    assert {r.seq: r.outcome for r in outcomes.collect()} == {10: "applied", 11: "conflict", 12: "conflict", 13: "missing"}


def test_latest_and_first_rows(spark):
    """Last occurrence of a key wins; of new keys the first is created."""
    rows = [(1, "A", "1"), (2, "B", "two words"), (3, "C", "bare"), (4, "A", "2")]
    df = spark.createDataFrame(rows, "seq bigint, key string, value string")
    assert {r.key: r.value for r in B.latest_by_key(df, ["key"], "seq").collect()} == {"A": "2", "B": "two words", "C": "bare"}
    added = B.idempotent_add(df, df.where("key = 'B'"), ["key"], "seq")
    assert {r.key: r.value for r in added.collect()} == {"A": "1", "C": "bare"}
    assert B.idempotent_add(df, df, ["key"], "seq").count() == 0


def test_children(spark):
    parents = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "id bigint, n bigint")
    children = spark.createDataFrame([(1, "a"), (1, "b"), (9, "c")], "pid bigint, s string")
    assert [r.s for r in B.orphans(children, "pid", parents, "id").collect()] == ["c"]
    assert [r.s for r in B.cascade_delete(children, "pid", parents.where("id = 1"), "id").collect()] == ["c"]
    wrong = B.count_mismatches(parents, "id", "n", children, "pid").collect()
    assert [tuple(r) for r in wrong] == [(3, 1, 0)]
    assert B.linked(children, "pid", parents, "id").count() == 2


def test_sequence_numbers_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), "id").repartition(7)
    found = K.assign_seq(df, "seq", ["k"], start=50).collect()
    assert sorted(r.seq for r in found) == list(range(50, 1050))
    assert all(r.seq == r.k + 50 for r in found)
    assert K.assign_seq(df.limit(0), "seq", ["k"]).count() == 0


def test_append_continues_and_checks_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("b",), ("a",)], "s string")
    assert sorted(tuple(r) for r in K.append_rows(df, path, order_by=["s"], keys=["s"]).collect()) == [(1, "a"), (2, "b")]
    more = spark.createDataFrame([("c",)], "s string")
    assert [tuple(r) for r in K.append_rows(more, path, order_by=["s"], keys=["s"]).collect()] == [(3, "c")]
    with pytest.raises(ValueError, match="primary key"):
        K.append_rows(df, path, order_by=["s"], keys=["s"])
    assert spark.read.parquet(path).count() == 3


def test_key_violations(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "x int, y string")
    stored = spark.createDataFrame([(3, "c"), (3, "c")], "x int, y string")
    found = {(r.x, r.y): r.problem for r in K.pk_violations(df, ["x", "y"], stored).collect()}
    assert found == {(1, "a"): "duplicate", (2, None): "null", (3, "c"): "exists"}
