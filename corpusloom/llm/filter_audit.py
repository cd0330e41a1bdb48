"""What filters remove, alone and after each other, in every order: failing-id relations and their joins."""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.session import materialise, work_folder

WHITE = " \t\n\x0b\f\r"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
# relation of all documents that fail a filter; the filters are numbered from 1
ANY = 0
# what the rows of a relation are counted for
ALL, GOOD, TOXIC = 0, 1, 2


def word_list(text: Column) -> Column:
    """Maximal runs without ASCII white space, in order."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions A to D: few words, few distinct words, many capitals, odd characters."""
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * F.lit(100).cast("bigint") > F.length(text) * F.lit(3).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def failing_ids(documents: DataFrame, key: str, text: str, part: str) -> tuple[DataFrame, str, list[str]]:
    """All rows (``row, id, part``), the folder of the id tables (``row, id, part`` by ``filter``), the filters' names.

    A row is named by its place, since keys may be null or repeat. E fails where a smaller
    key has the identical text; a null key neither fails it nor makes others fail.
    """
    spark = documents.sparkSession
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("t"), word_list(whole).alias("w"),
    )
    tests = text_filters(F.col("t"), F.col("w"))
    marks = materialise(
        rows.select(
            "row", "id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"),
            F.array(*(F.when(fails, F.lit(name)) for name, fails in tests.items())).alias("fails"),
        ),
        "audit-marks",
    )
    # the smallest key of a text is the only one that does not fail; the anti join deals copies out by their keys
    named = marks.where("id is not null").select("digest", "id", "row", "part")
    first = named.groupBy("digest").agg(F.min("id").alias("id"))
    copies = named.join(first, ["digest", "id"], "left_anti").select("row", "id", "part", F.lit("E").alias("filter"))
    own = marks.select("row", "id", "part", F.explode(F.array_compact("fails")).alias("filter"))
    folder = work_folder(spark, "failing-ids")
    own.select("row", "id", "part", "filter").union(copies).write.partitionBy("filter").parquet(folder)
    return marks.select("row", "id", "part"), folder, [*tests, "E"]


def _id_table(like: DataFrame, folder: str) -> DataFrame:
    """``row, id, part, filter`` of all id tables; none may have a row."""
    schema = like.select("row", "id", "part", F.lit("").alias("filter")).schema
    return like.sparkSession.read.schema(schema).parquet(folder)


def _steps(names: list[str]) -> str:
    """Every order and step as JSON, with the counts that it needs: (relation, counted for, filters before)."""
    bit = {name: 1 << i for i, name in enumerate(names)}
    number = {name: i + 1 for i, name in enumerate(names)}
    rows = []
    for order in permutations(names):
        for i, name in enumerate(order):
            before = sorted(order[:i], key=names.index)
            prefix = sum(bit[b] for b in before)
            others = sum(bit.values()) - bit[name]
            rows.append({
                "filter_order": "".join(order), "step": i + 1, "filter": name,
                "kept": f"{ANY} {ALL} {prefix + bit[name]}", "removed": f"{number[name]} {ALL} {prefix}",
                # the ids that were gone when each filter before met those that still stood, in the filters' own order
                "redundant": [f"{number[name]} {sum(bit[b] for b in before[:j])} by {number[s]}" for j, s in enumerate(before)],
                "unique_fails": f"{number[name]} {ALL} {others}",
                "good_lost": f"{number[name]} {GOOD} {prefix}", "toxic_lost": f"{number[name]} {TOXIC} {prefix}",
            })
    return json.dumps(rows)


_STEP = (
    "array<struct<filter_order string, step int, filter string, kept string, removed string, redundant array<string>, "
    "unique_fails string, good_lost string, toxic_lost string>>"
)


def audit(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """Counts per ``part, filter_order, step``: see COUNTS; all orders of the five filters, zeros included.

    One id table per filter is stored. A relation holds the ids that fail a filter and
    still stand after a set of other filters (a prefix of some order; its order does
    not change who stands). Filter by filter, every relation made so far meets the
    next id table: the left-anti join is the relation of the longer prefix, the
    left-semi join the ids that are redundant from there on. The relation of documents that fail
    anything gives the survivors; those that fail nothing survive everywhere and are
    counted once. Label losses are the same relations over left-semi joins with the
    labelled ids. All counts are per row: repeated rows count as often as they occur,
    a null text is empty, a null part is the empty string, a document without label or without a key is
    no loss. An empty table gives an empty result. Only the named columns are read.
    """
    spark = documents.sparkSession
    rows, folder, names = failing_ids(documents, key, text, part)
    failing = _id_table(rows, folder)
    number = F.create_map(*(F.lit(x) for i, name in enumerate(names) for x in (name, i + 1)))
    relation = failing.select(number[F.col("filter")].alias("relation"), "id", "row", "part")
    good = labels.where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("id")).distinct()

    def started(rows: DataFrame, counted: int) -> DataFrame:
        return rows.select("relation", F.lit(counted).alias("counted"), F.lit(0).alias("prefix"), "row", "part")

    dirty = rows.join(failing.select("row").distinct(), "row", "left_semi").withColumn("relation", F.lit(ANY))
    clean = rows.join(failing.select("row").distinct(), "row", "left_anti").groupBy("part").agg(F.count(F.lit(1)).alias("clean"))
    base = (
        started(dirty, ALL).union(started(relation, ALL))
        .union(started(relation.join(good, "id", "left_semi"), GOOD)).union(started(relation.join(toxic, "id", "left_semi"), TOXIC))
    )
    standing = materialise(base, "standing")
    gone = None
    for i, name in enumerate(names):
        table = failing.where(F.col("filter") == name).select("row").distinct()
        others = standing.where(F.col("relation") != i + 1)
        met = others.join(table, "row", "left_semi").withColumn("by", F.lit(i + 1)).union(
            others.join(table, "row", "left_anti").withColumn("by", F.lit(0))
        )
        met = materialise(met.select("relation", "counted", "prefix", "row", "part", "by"), f"standing-{name}")
        passed = met.where("by = 0").drop("by").withColumn("prefix", F.col("prefix") + (1 << i))
        standing = standing.union(passed)
        removed = met.where((F.col("by") > 0) & (F.col("counted") == ALL) & (F.col("relation") != ANY))
        gone = removed if gone is None else gone.union(removed)
    stand = standing.groupBy("part", F.concat_ws(" ", "relation", "counted", "prefix").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    went = gone.groupBy("part", F.concat(F.concat_ws(" ", "relation", "prefix"), F.lit(" by "), F.col("by")).alias("code")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # at most 32 + 3 * 80 + 80 counts a part
    counts = stand.union(went).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("counts"))
    parts = materialise(
        clean.join(counts, "part", "full").select(
            "part", F.coalesce("clean", F.lit(0)).alias("clean"),
            F.coalesce("counts", F.create_map().cast("map<string,bigint>")).alias("counts"),
        ),
        "audit-parts",
    )
    steps = parts.select("part", "clean", "counts", F.explode(F.from_json(F.lit(_steps(names)), _STEP)).alias("s"))

    def count(code: Column) -> Column:
        return F.coalesce(F.try_element_at("counts", code), F.lit(0).cast("bigint"))

    zero = F.lit(0).cast("bigint")
    told = steps.select(
        "part", "s.filter_order", "s.step", "s.filter", (F.col("clean") + count(F.col("s.kept"))).alias("kept"),
        *(count(F.col(f"s.{name}")).alias(name) for name in ("removed", "unique_fails", "good_lost", "toxic_lost")),
        F.aggregate("s.redundant", zero, lambda total, code: total + count(code)).alias("redundant"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))  # one row an order
    return told.withColumn("shapley", shapley).select("part", "filter_order", "step", *COUNTS)
