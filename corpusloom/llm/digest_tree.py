"""Exact duplicates: sorted runs of digests, merged in rounds over a tree; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.session import materialise

FAN_IN = 8
# scan partitions beyond this many share runs, so that no shuffle has more blocks than the square of it
MOST_RUNS = 4_096

# a group of equal texts: 64-bit digest, and what every merge verifies beside it
GROUP = ["digest", "proof", "bytes"]


def normalised(text: str | Column) -> Column:
    """The text with every run of ASCII white space as one space; a null text is empty."""
    column = F.col(text) if isinstance(text, str) else text
    # a single space stands for itself and is not matched
    return F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*", " ")


def radices(runs: int, fan_in: int = FAN_IN) -> list[int]:
    """Fan-in of each round: the fewest rounds of at most ``fan_in`` runs, whose product is at least ``runs``."""
    found, rest = [], runs
    while rest > 1:
        rounds = 1
        while fan_in**rounds < rest:
            rounds += 1
        step = next(n for n in range(2, fan_in + 1) if n**rounds >= rest)
        found.append(step)
        rest = -(-rest // step)
    return found


def _merged(rows: DataFrame, slots: int) -> DataFrame:
    """One row per slot and verified group; the rows of a slot are one partition.

    The smallest row is a struct, for which Spark merges sorted rows; it keeps the partitions of the slots.
    """
    return rows.repartitionById(slots, "slot").groupBy("slot", *GROUP).agg(F.min("least").alias("least"), F.sum("n").alias("n"))


def tree_merge(runs: DataFrame, steps: list[int], slots: int) -> DataFrame:
    """``slot, digest, proof, bytes, least, n`` over all runs, every group once.

    ``runs`` has the same columns, each group once per slot. In a round the slots that
    differ in one digit only exchange parts of their runs: a row moves to the slot
    whose digit is that of its digest, and each slot merges what its ``fan_in``
    partners send. After the last round all digits of a slot are those of its digests.
    """
    below = 1
    for step in steps:
        digit = F.expr(f"cast(pmod(digest, {slots}) div {below} % {step} as int)")
        own = F.expr(f"cast(slot div {below} % {step} as int)")
        runs = _merged(runs.withColumn("slot", F.col("slot") + (digit - own) * below), slots)
        below *= step
    return runs


def _grouped(documents: DataFrame, key: str, text: str, carried: Column, fan_in: int, most_runs: int) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256, carried`` for every row."""
    marks = materialise(
        documents.select(F.col(key).alias("id"), normalised(text).alias("t"), carried.alias("carried")).select(
            (F.spark_partition_id() % most_runs).cast("int").alias("slot"), F.monotonically_increasing_id().alias("row"), "id",
            F.xxhash64("t").alias("digest"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("proof"),
            F.octet_length("t").alias("bytes"), "carried",
        ),
        "digest-marks",
    )
    steps = radices((marks.agg(F.max("slot")).first()[0] or 0) + 1, fan_in)
    slots = 1
    for step in steps:
        slots *= step
    # a null id is no smallest one while there is another; the row decides between repeated ids
    least = F.struct(F.col("id").isNull().alias("missing"), "id", "row").alias("least")
    runs = materialise(_merged(marks.select("slot", *GROUP, least, F.lit(1).cast("bigint").alias("n")), slots), "digest-runs")
    groups = materialise(tree_merge(runs, steps, slots).where("n > 1").drop("slot"), "digest-groups")
    # back to the documents: a group meets its runs, at most one row each, and these their own documents
    told = runs.select("slot", *GROUP).join(groups, GROUP)
    found = marks.repartitionById(slots, "slot").join(told.repartitionById(slots, "slot"), ["slot", *GROUP], "left")
    alone = F.col("n").isNull()
    return found.select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"), (alone | (F.col("row") == F.col("least.row"))).alias("kept"),
        F.lower(F.hex("proof")).alias("text_sha256"), "carried",
    )


def exact_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", fan_in: int = FAN_IN, most_runs: int = MOST_RUNS
) -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` for every row.

    Texts are equal if they are the same after white-space runs became single spaces;
    null counts as empty. Every scan partition is a run of digests; runs are merged in
    rounds of ``fan_in`` partners, and at every level rows are merged only if 64-bit
    digest, SHA-256 and length agree. A run holds a group once, so a group of any size
    is at most one row per run from the first level on, and its documents stay spread
    over the partitions that they were read from.

    Of equal texts the row of the smallest key stays; of rows that repeat that key one
    stays. A null key stays only where all keys of its texts are null. Empty tables
    give empty results; other columns are not read.
    """
    found = _grouped(documents, key, text, F.lit(None).cast("int"), fan_in, most_runs)
    return found.drop("carried").withColumnRenamed("id", key)


def without_exact_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", fan_in: int = FAN_IN, most_runs: int = MOST_RUNS
) -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns; the rules are those of ``exact_duplicates``."""
    found = _grouped(documents, key, text, F.struct(*(F.col(f"`{c}`") for c in documents.columns)), fan_in, most_runs)
    return found.where("kept").select("carried.*")
