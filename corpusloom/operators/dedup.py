"""Fingerprint comparison, collision decisions and duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.text import short_sha
from corpusloom.session import broadcast_if_small, materialise

# Fixed value: modification times closer than this are equal.
MTIME_TOLERANCE = 1e-3

# Texts of the messages.
SHA_TEXT = "sha256 match"
STAT_TEXT = "size+mtime match"
NO_FINGERPRINT_TEXT = "no fingerprint in existing row"
SHA_DIFFERS_TEXT = "sha256 differs (db=%s, new=%s)"
STAT_DIFFERS_TEXT = "size/mtime differ (db=%s, new=%s)"
NAME_TEXT = "filename match (lowest doc_id=%d of %d)%s"
DUPLICATE_TEXT = "fingerprint duplicate of doc_id=%s (%s)"
LOCAL_MISSING_TEXT = ", local fingerprint unavailable"
STORED_MISSING_TEXT = " has no fingerprint in DB; assuming duplicate"
POLICY_TEXTS = {"skip": ", policy=skip", "fail": "; policy=fail"}

MATCH_SHA, DIFF_SHA, MATCH_STAT, DIFF_STAT, NONE = "match_sha", "diff_sha", "match_stat", "diff_stat", "none"
POLICIES = ("ingest", "skip", "fail", "fingerprint")


def _has_sha(fp: Column) -> Column:
    return F.coalesce(fp["sha256"] != "", F.lit(False))


def _has_stat(fp: Column) -> Column:
    return fp["file_size"].isNotNull() & fp["mtime"].isNotNull()


def fingerprint_match(new: Column, old: Column) -> Column:
    """Class of a comparison: a stored digest decides alone, else size and time do."""
    same_stat = (new["file_size"] == old["file_size"]) & (F.abs(old["mtime"] - new["mtime"]) < MTIME_TOLERANCE)
    return (
        F.when(_has_sha(old) & (old["sha256"] == new["sha256"]), MATCH_SHA)
        .when(_has_sha(old), DIFF_SHA)
        .when(_has_stat(old) & F.coalesce(same_stat, F.lit(False)), MATCH_STAT)
        .when(_has_stat(old), DIFF_STAT)
        .otherwise(NONE)
    )


def match_reason(new: Column, old: Column) -> Column:
    """Text that explains ``fingerprint_match``."""
    both = lambda fp: F.concat(fp["file_size"].cast("string"), F.lit("/"), fp["mtime"].cast("string"))
    kind = fingerprint_match(new, old)
    return (
        F.when(kind == MATCH_SHA, F.lit(SHA_TEXT))
        .when(kind == DIFF_SHA, F.format_string(SHA_DIFFERS_TEXT, short_sha(old["sha256"]), short_sha(new["sha256"])))
        .when(kind == MATCH_STAT, F.lit(STAT_TEXT))
        .when(kind == DIFF_STAT, F.format_string(STAT_DIFFERS_TEXT, both(old), both(new)))
        .otherwise(F.lit(NO_FINGERPRINT_TEXT))
    )


def collision_ids(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Every existing row that shares a file name with a new file: ``filename, id``."""
    return existing.select("filename", "id").join(new.select("filename").distinct(), "filename", "left_semi")


# What an index row answers: any file of the name, one with the digest, one with the size at the step of time
NAME_PROBE, SHA_PROBE, STAT_PROBE = "name", "sha", "stat"
INDEX_KEY = ["filename", "probe"]
INDEX_COLUMNS = "filename string, probe string, mtime double, lowest_id bigint, n bigint, n_no_fp bigint"


def _probe(kind: str, *values: Column) -> Column:
    return F.concat_ws(" ", F.lit(kind), *(value.cast("string") for value in values))


def _step(mtime: Column) -> Column:
    return F.floor(mtime / (2 * MTIME_TOLERANCE))


def name_index(existing: DataFrame) -> DataFrame:
    """What decisions need of stored rows ``id, filename, fingerprint``, in one pass: INDEX_COLUMNS.

    One row per name with counts and the lowest id, one per name and digest, and one per
    name, size and time; all are aggregated before the shuffle, so a name of many rows is
    spread by its digests. Indexes of parts of a table may be put together.
    """
    fp = F.col("fingerprint")
    no_fp = F.coalesce(~_has_sha(fp) & ~_has_stat(fp), F.lit(True)).cast("bigint")
    none = F.lit(None).cast("double")
    entry = lambda probe, mtime, missing: F.struct(probe.alias("probe"), mtime.alias("mtime"), missing.alias("missing"))
    own = (
        F.when(_has_sha(fp), entry(_probe(SHA_PROBE, fp["sha256"]), none, F.lit(0).cast("bigint")))
        .when(_has_stat(fp), entry(_probe(STAT_PROBE, fp["file_size"], _step(fp["mtime"])), fp["mtime"], F.lit(0).cast("bigint")))
    )
    entries = F.array_compact(F.array(entry(_probe(NAME_PROBE), none, no_fp), own))
    rows = existing.where("filename is not null").select("id", "filename", F.explode(entries).alias("e")).select("id", "filename", "e.*")
    return reduced_index(rows.select(
        "filename", "probe", "mtime", F.col("id").alias("lowest_id"), F.lit(1).cast("bigint").alias("n"), F.col("missing").alias("n_no_fp")
    ))


def reduced_index(index: DataFrame) -> DataFrame:
    """An index with one row per entry again; what one run (column ``run``) stored twice counts once."""
    if "run" in index.columns:
        index = index.groupBy(*INDEX_KEY, "mtime", "run").agg(
            F.min("lowest_id").alias("lowest_id"), F.max("n").alias("n"), F.max("n_no_fp").alias("n_no_fp")
        )
    return index.groupBy(*INDEX_KEY, "mtime").agg(
        F.min("lowest_id").alias("lowest_id"), F.sum("n").alias("n"), F.sum("n_no_fp").alias("n_no_fp")
    )


def _probes(files: DataFrame, fingerprints: bool) -> DataFrame:
    """Every entry that new files ask for, once; of a time its step and the two beside it."""
    fp = F.col("fingerprint")
    asked = [_probe(NAME_PROBE)]
    if fingerprints:
        asked += [F.when(_has_sha(fp), _probe(SHA_PROBE, fp["sha256"]))]
        asked += [F.when(_has_stat(fp), _probe(STAT_PROBE, fp["file_size"], _step(fp["mtime"]) + d)) for d in (-1, 0, 1)]
    return files.select("filename", F.explode(F.array_compact(F.array(*asked))).alias("probe")).distinct()


def _matches(files: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Lowest id of a stored row with an equal fingerprint, per new file: ``key, matched_id, match``.

    Both comparisons are equi joins against index rows, so many copies under one name
    never meet as pairs. A step holds only as many distinct times as a double can tell apart.
    """
    fp = F.col("fingerprint")
    own = files.select(
        key, "filename", _probe(SHA_PROBE, fp["sha256"]).alias("_sha"), _has_sha(fp).alias("_by_sha"), fp["mtime"].alias("_mtime"),
        F.when(_has_stat(fp), F.array(*[_probe(STAT_PROBE, fp["file_size"], _step(fp["mtime"]) + d) for d in (-1, 0, 1)])).alias("_stats"),
    )
    by_sha = hits.where(F.col("probe").startswith(SHA_PROBE)).select("filename", F.col("probe").alias("_sha"), F.col("lowest_id").alias("id_sha"))
    by_stat = hits.where(F.col("probe").startswith(STAT_PROBE)).select("filename", "probe", F.col("mtime").alias("_old"), "lowest_id")
    near = (
        own.select(key, "filename", "_mtime", F.explode("_stats").alias("probe")).join(by_stat, INDEX_KEY)
        .where(F.abs(F.col("_old") - F.col("_mtime")) < MTIME_TOLERANCE)
        .groupBy(key).agg(F.min("lowest_id").alias("id_stat"))
    )
    return (
        own.where("_by_sha").select(key, "filename", "_sha").join(by_sha, ["filename", "_sha"]).select(key, "id_sha")
        .join(near, key, "full")
        .select(
            key,
            F.least("id_sha", "id_stat").alias("matched_id"),
            F.when(F.col("id_sha") <= F.coalesce("id_stat", "id_sha"), MATCH_SHA).otherwise(MATCH_STAT).alias("match"),
        )
    )


def collision_decision(
    new: DataFrame,
    existing: DataFrame,
    policy: str = "fingerprint",
    key: str = "source_path",
) -> DataFrame:
    """Keep or skip every new file: ``key, filename, decision, matched_id, reason``.

    ``new`` has ``key`` (unique), ``filename`` and ``fingerprint``; ``existing`` has
    ``id``, ``filename`` and ``fingerprint`` (a struct, or NULL if unknown), or is a ``name_index``
    of such rows. The decision is ``keep``, ``skip`` or, with policy ``fail``, ``abort``. A policy that
    is not known acts as ``fingerprint``. The stored side is read once: what new files ask
    for is looked up in its index, and only these entries go on.
    """
    policy = policy.lower()
    fp = F.col("fingerprint")
    files = new.select(key, "filename", fp["sha256"].isNotNull().alias("_has_fp"))
    if policy == "ingest":
        return files.select(
            key, "filename", F.lit("keep").alias("decision"), F.lit(None).cast("bigint").alias("matched_id"),
            F.lit(None).cast("string").alias("reason"),
        )
    by_print = policy not in ("skip", "fail")
    if "probe" not in existing.columns:
        names = broadcast_if_small(new.select("filename").distinct())
        existing = name_index(existing.select("id", "filename", "fingerprint").join(names, "filename", "left_semi"))
    hits = reduced_index(existing.join(_probes(new, by_print), INDEX_KEY, "left_semi"))
    if by_print:
        hits = materialise(hits, "name-hits")
    names = hits.where(F.col("probe") == NAME_PROBE).select(
        "filename", F.col("n").alias("n_existing"), "n_no_fp", "lowest_id"
    )
    judged = files.join(names, "filename", "left")
    collides = F.col("n_existing").isNotNull()
    by_name = lambda rest: F.format_string(NAME_TEXT, F.col("lowest_id"), F.col("n_existing"), F.lit(rest))
    if not by_print:
        word = "skip" if policy == "skip" else "abort"
        return judged.select(
            key, "filename", F.when(collides, word).otherwise("keep").alias("decision"),
            F.lit(None).cast("bigint").alias("matched_id"),
            F.when(collides, by_name(POLICY_TEXTS[policy])).alias("reason"),
        )
    judged = judged.join(_matches(new, hits, key), key, "left")
    why = F.when(F.col("match") == MATCH_SHA, SHA_TEXT).otherwise(STAT_TEXT)
    missing = collides & ~F.coalesce(F.col("_has_fp"), F.lit(False))
    matched = collides & F.col("matched_id").isNotNull()
    unknown = collides & (F.col("n_no_fp") == F.col("n_existing"))
    reason = (
        F.when(missing, by_name(LOCAL_MISSING_TEXT))
        .when(matched, F.format_string(DUPLICATE_TEXT, F.col("matched_id").cast("string"), why))
        .when(unknown, by_name(STORED_MISSING_TEXT))
    )
    return judged.select(
        key, "filename",
        F.when(reason.isNotNull(), "skip").otherwise("keep").alias("decision"),
        F.when(matched & ~missing, F.col("matched_id")).alias("matched_id"),
        reason.alias("reason"),
    )


def new_only(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Files whose name is not stored yet."""
    return new.join(existing.select("filename"), "filename", "left_anti")


def duplicate_groups(df: DataFrame, key: str, digest: Column) -> DataFrame:
    """Groups of rows with one content digest: ``sha256, n, first_id``; only digests are shuffled."""
    return (
        df.select(digest.alias("sha256"), F.col(key).alias("_id"))
        .groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first_id"))
        .where(F.col("n") > 1)
    )


def duplicate_members(df: DataFrame, key: str, digest: Column) -> DataFrame:
    """All rows of those groups, one row each: ``key, sha256, first_id``."""
    rows = df.select(F.col(key), digest.alias("sha256"))
    return rows.join(duplicate_groups(df, key, digest).drop("n"), "sha256").select(key, "sha256", "first_id")
