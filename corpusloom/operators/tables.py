"""Table reads and changes with structured arguments."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.session import broadcast_if_small, materialise

NULL_WORDS = {"null": None, "true": True, "false": False}


def like_pattern(pattern: str) -> str:
    """SQL pattern for a text where ``*`` is the wildcard and nothing else is special."""
    for char in "\\%_":
        pattern = pattern.replace(char, "\\" + char)
    return pattern.replace("*", "%")


def fts(text: Column, terms: list[str]) -> Column:
    """True where every term occurs as a whole word, in any case; no stemming, no stop words."""
    found = F.lit(True)
    for term in terms:
        quoted = "\\Q" + term.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E"
        found = found & F.lower(text).rlike(rf"(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])")
    return found


def predicate(df: DataFrame, field: str, operator: str, values: list[Any]) -> Column:
    """One structured filter as a column; values are cast to the type of the field."""
    column = F.col(field)
    as_type = df.schema[field].dataType
    value = lambda v: F.lit(v).cast(as_type)
    compare = {
        "eq": lambda: column == value(values[0]),
        "neq": lambda: column != value(values[0]),
        "gt": lambda: column > value(values[0]),
        "gte": lambda: column >= value(values[0]),
        "lt": lambda: column < value(values[0]),
        "lte": lambda: column <= value(values[0]),
        "in": lambda: column.isin([value(v) for v in values]),
        "is": lambda: column.eqNullSafe(F.lit(NULL_WORDS[str(values[0]).lower()]).cast(as_type)),
        "not_null": lambda: column.isNotNull(),
        "like": lambda: F.like(column, F.lit(like_pattern(values[0]))),
        "ilike": lambda: F.ilike(column, F.lit(like_pattern(values[0]))),
        "fts": lambda: fts(column, list(values)),
    }
    if operator not in compare:
        raise ValueError(f"unknown operator: {operator}")
    return compare[operator]()


def apply_filters(
    df: DataFrame,
    filters: list[dict[str, dict[str, Any]]],
    open_statuses: DataFrame | None = None,
) -> DataFrame:
    """All filters of ``[{field: {"operator": o, "values": [...]}}]`` hold.

    Operator ``o`` keeps rows whose field is one of the open statuses, given as a
    one-column frame.
    """
    result = df
    for entry in filters:
        for field, spec in entry.items():
            if spec["operator"] == "o":
                if open_statuses is None:
                    raise ValueError("operator 'o' needs the open statuses")
                statuses = open_statuses.select(F.col(open_statuses.columns[0]).alias(field)).distinct()
                result = result.join(broadcast_if_small(statuses), field, "left_semi")
            else:
                result = result.where(predicate(df, field, spec["operator"], spec.get("values", [])))
    return result


def order_columns(order: list[tuple[str, str]]) -> list[Column]:
    """Sort columns with NULLs last when ascending and first when descending."""
    return [
        F.col(name).desc_nulls_first() if direction == "desc" else F.col(name).asc_nulls_last()
        for name, direction in order
    ]


def read_table(
    df: DataFrame,
    select: list[str] | None = None,
    filters: list[dict[str, dict[str, Any]]] | None = None,
    order: list[tuple[str, str]] | None = None,
    limit: int | None = None,
    offset: int = 0,
    open_statuses: DataFrame | None = None,
) -> DataFrame:
    """Filter, sort, slice and select; ``limit=0`` only checks that the table can be read."""
    result = apply_filters(df, filters or [], open_statuses)
    if order:
        result = result.orderBy(*order_columns(order))
    if offset:
        result = result.offset(offset)
    if limit is not None:
        result = result.limit(limit)
    return result.select(*select) if select else result


def page(df: DataFrame, page_no: int, page_size: int, order: list[tuple[str, str]]) -> DataFrame:
    """Rows of a 1-based page; ``order`` should end in a unique column."""
    if page_no < 1 or page_size < 0:
        raise ValueError("page_no is 1-based and page_size is not negative")
    return read_table(df, order=order, limit=page_size, offset=(page_no - 1) * page_size)


class Pages:
    """A sorted table of which any page is read without sorting, or reading, the rows before it.

    The rows are range-sorted and written once. The start of a page follows from the
    number of rows of each written partition; the rows of the page are then found by their place.
    """

    def __init__(self, df: DataFrame, order: list[tuple[str, str]]):
        self.columns = df.columns
        self.rows = materialise(df.orderBy(*order_columns(order)).withColumn("_pos", F.monotonically_increasing_id()), "pages")
        part = F.shiftright("_pos", 33)
        self.counts = [tuple(r) for r in self.rows.groupBy(part.alias("part")).count().orderBy("part").collect()]

    def page(self, page_no: int, page_size: int) -> DataFrame:
        """Rows of a 1-based page, in order."""
        if page_no < 1 or page_size < 0:
            raise ValueError("page_no is 1-based and page_size is not negative")
        first, places, before = (page_no - 1) * page_size, F.lit(False), 0
        for part, count in self.counts:
            low, high = max(first - before, 0), min(first + page_size - before, count)
            if low < high:
                places = places | F.col("_pos").between((part << 33) + low, (part << 33) + high - 1)
            before += count
        return self.rows.where(places).orderBy("_pos").select(*self.columns)


def page_envelope(df: DataFrame, page_no: int, page_size: int) -> DataFrame:
    """One row ``total, count, pageSize, offset``; ``offset`` is the page number."""
    left = F.col("total") - (page_no - 1) * page_size
    count = F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(page_size).cast("bigint"), left))
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", count.alias("count"), F.lit(page_size).alias("pageSize"), F.lit(page_no).alias("offset")
    )


def update_where(df: DataFrame, pred: Column, sets: dict[str, Any]) -> DataFrame:
    """The table after setting columns in the matching rows; a NULL predicate does not match."""
    hit = F.coalesce(pred, F.lit(False))
    changed = {}
    for name, new in sets.items():
        new = new if isinstance(new, Column) else F.lit(new)
        changed[name] = F.when(hit, new.cast(df.schema[name].dataType)).otherwise(F.col(name))
    return df.withColumns(changed)


def delete_where(df: DataFrame, pred: Column) -> DataFrame:
    """The table without the matching rows; a NULL predicate keeps the row."""
    return df.where(~F.coalesce(pred, F.lit(False)))


def cascade_delete(children: DataFrame, foreign_key: str, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows that remain when their parents are deleted."""
    gone = deleted.select(F.col(key).alias(foreign_key))
    return children.join(gone, foreign_key, "left_anti")


def orphans(children: DataFrame, foreign_key: str, parents: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent."""
    return children.join(parents.select(F.col(key).alias(foreign_key)), foreign_key, "left_anti")


def count_mismatches(
    parents: DataFrame, key: str, declared: str, children: DataFrame, foreign_key: str
) -> DataFrame:
    """Parents whose declared number of children is not the stored one: ``key, declared, stored``."""
    stored = children.groupBy(F.col(foreign_key).alias(key)).agg(F.count(F.lit(1)).alias("stored"))
    return (
        parents.select(key, F.col(declared).alias("declared"))
        .join(stored, key, "left")
        .select(key, "declared", F.coalesce("stored", F.lit(0)).alias("stored"))
        .where(~F.col("declared").eqNullSafe(F.col("stored")))
    )


def linked(children: DataFrame, foreign_key: str, parents: DataFrame, key: str) -> DataFrame:
    """Children with their parents; children of parents that were not committed stay invisible."""
    return children.join(parents, children[foreign_key] == parents[key], "inner")


def insert_default_if_absent(
    users: DataFrame,
    preferences: DataFrame,
    user_preferences: DataFrame,
    name: str,
    value: str,
) -> DataFrame:
    """Rows ``pid, uid, value`` to add so that every user has the named preference.

    Nothing is added if the preference does not exist; running it twice adds nothing.
    """
    pid = preferences.where(F.col("name") == name).agg(F.min("id").alias("pid")).scalar()
    wanted = users.select(
        pid.alias("pid"), F.col("id").alias("uid"), F.lit(value).alias("value")
    ).where(F.col("pid").isNotNull()).distinct()
    return wanted.join(user_preferences.select("pid", "uid"), ["pid", "uid"], "left_anti")


def optimistic_update(
    base: DataFrame, changes: DataFrame, key: str, version: str, seq: str, sets: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(table after the changes, one outcome per change: applied, conflict or missing).

    A change is applied if it names the current version. Of several such changes to
    one row, the first by ``seq`` (unique) wins; for the others the version is stale.
    """
    fields = F.struct(F.col(seq), *[F.col(c) for c in sets])
    first = changes.groupBy(key, version).agg(F.min_by(fields, seq).alias("_win"))
    current = base.select(key, F.col(version).alias("_current"))
    # an inner join: a semi join would be pushed below the aggregate and move every change
    fits = first.join(current, key).where(F.col(version) == F.col("_current"))
    winners = fits.select(key, "_win")
    status = (
        F.when(F.col("_current").isNull(), "missing")
        .when(F.col("_win." + seq) == F.col(seq), "applied")
        .otherwise("conflict")
    )
    # rows of the table and their winners are one per key; only the changes may be skewed
    outcomes = changes.join(current.join(winners, key, "left"), key, "left").select(
        key, seq, status.alias("outcome"), F.col("_current").alias("current_version")
    )
    new = {c: F.when(F.col("_win").isNotNull(), F.col("_win." + c)).otherwise(F.col(c)) for c in sets}
    new[version] = F.col(version) + F.when(F.col("_win").isNotNull(), 1).otherwise(0)
    updated = base.join(winners, key, "left").withColumns(new).select(*base.columns)
    return updated, outcomes


def idempotent_add(df: DataFrame, existing: DataFrame, key: list[str], order_by: str) -> DataFrame:
    """Rows to create: the first per key, unless the key is already there."""
    first = df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), order_by).alias("_row")).select("_row.*")
    # an outer join: an anti join would be pushed below the aggregate and move every row
    known = existing.select(*key).distinct().withColumn("_known", F.lit(True))
    return first.join(known, key, "left").where(F.col("_known").isNull()).select(*df.columns)


def latest_by_key(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of every key."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), seq).alias("_row")).select("_row.*")


def earliest_by(df: DataFrame, seq: str, cols: list[str]) -> DataFrame:
    """One row: the given columns of the row with the lowest number."""
    return df.agg(F.min_by(F.struct(*cols), seq).alias("_row")).select("_row.*")
