"""JSON, HAL and XML record expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

HAL_COLLECTION = (
    "total bigint, count bigint, pageSize bigint, offset bigint, "
    "_embedded struct<elements: array<struct<id: bigint, subject: string, lockVersion: bigint, "
    "_links: struct<status: struct<href: string, title: string>>>>>"
)
HAL_ERROR = "_type string, errorIdentifier string, message string"
EMBEDDING_RESPONSE = (
    "data array<struct<embedding: array<double>>>, embedding array<double>, "
    "vectors array<array<double>>, base_resp struct<status_code: int, status_msg: string>"
)
# What a HAL error status asks the caller to do.
HAL_ACTIONS = {401: "stop", 409: "refetch", 422: "fix_input"}


# Texts of the errors.
SINGLE_MISSING_TEXT = "embedding response missing 'data[0].embedding' or 'embedding'"
VECTORS_MISSING_TEXT = "response missing 'vectors'"


def metadata_get(df: DataFrame, meta: str, path: str, as_type: str = "string") -> Column:
    """One value from a metadata column, held as VARIANT or as JSON text; NULL if absent."""
    column = F.col(meta)
    if isinstance(df.schema[meta].dataType, T.VariantType):
        return F.try_variant_get(column, path, as_type)
    return F.get_json_object(column, path).try_cast(as_type)


def json_build(df: DataFrame, drop: list[str] | tuple[str, ...] = (), extra: dict[str, Column] | None = None) -> Column:
    """The row as a JSON object, without some columns and with added ones; NULLs are kept."""
    kept = [F.col(c) for c in df.columns if c not in drop and c not in (extra or {})]
    added = [value.alias(name) for name, value in (extra or {}).items()]
    return F.to_json(F.struct(*kept, *added), {"ignoreNullFields": "false"})


def json_array(rows: DataFrame, order: list[Column], obj: Column) -> DataFrame:
    """One row holding a JSON array of ``obj`` in the given order; no rows give ``[]``.

    Meant for the few rows of a top-k result, which is where the array form is used.
    """
    keys = [key.alias(f"k{i}") for i, key in enumerate(order)]
    sorted_rows = F.array_sort(F.collect_list(F.struct(*keys, obj.alias("obj"))))
    body = F.array_join(F.transform(sorted_rows, lambda r: r["obj"]), ",")
    return rows.agg(F.concat(F.lit("["), body, F.lit("]")).alias("result"))


def rank_rows_json(found: DataFrame, key: str, include_d: bool = False) -> DataFrame:
    """A search result as one JSON array by distance; ``include_d`` repeats the distance as ``d``."""
    extra = {"d": F.col("distance")} if include_d else None
    return json_array(found, [F.col("distance"), F.col(key)], json_build(found, extra=extra))


def json_each_text(df: DataFrame, obj: str) -> DataFrame:
    """One row per key of a JSON object: ``pos``, ``key``, ``value`` as text."""
    # the outer form keeps the optimizer from parsing twice, for a filter and for the rows
    pairs = F.map_entries(F.from_json(F.col(obj), "map<string,string>"))
    return df.select("*", F.posexplode_outer(pairs).alias("pos", "pair")).where(F.col("pos").isNotNull()).select(
        *df.columns, "pos", F.col("pair.key").alias("key"), F.col("pair.value").alias("value")
    )


def hal_elements(df: DataFrame, doc: str, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Elements of a HAL collection: ``id``, ``subject``, ``status``."""
    parsed = F.from_json(F.col(doc), HAL_COLLECTION)
    return (
        df.select(*keep, F.explode_outer(parsed["_embedded"]["elements"]).alias("e"))
        .where(F.col("e").isNotNull())
        .select(
            *keep,
            F.col("e.id").alias("id"),
            F.col("e.subject").alias("subject"),
            F.col("e._links.status.title").alias("status"),
        )
    )


def hal_page(doc: Column) -> Column:
    """Paging fields of a HAL collection as a struct."""
    parsed = F.from_json(doc, HAL_COLLECTION)
    return F.struct(*[parsed[name].alias(name) for name in ("total", "count", "pageSize", "offset")])


def hal_error(doc: Column, status: Column) -> Column:
    """Struct ``is_error, identifier, message, action`` of a HAL answer."""
    parsed = F.from_json(doc, HAL_ERROR)
    is_error = F.coalesce(parsed["_type"] == "Error", F.lit(False))
    action = F.lit("report")
    for code, name in HAL_ACTIONS.items():
        action = F.when(status == code, F.lit(name)).otherwise(action)
    return F.struct(
        is_error.alias("is_error"),
        F.when(is_error, parsed["errorIdentifier"]).alias("identifier"),
        F.when(is_error, parsed["message"]).alias("message"),
        F.when(is_error, action).alias("action"),
    )


def xml_values(xml: Column, name: str) -> Column:
    """Texts of all elements with a local name, in any namespace."""
    if not name.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"not an element name: {name!r}")
    return F.xpath(xml, F.lit(f"//*[local-name()='{name}']/text()"))


def parse_embedding_response(body: Column, shape: str = "openai") -> Column:
    """Struct ``vectors, error`` of a model answer.

    ``single``: ``data[0].embedding``, else ``embedding``. ``openai``: every
    ``data[].embedding``. ``vectors``: ``vectors[]``, where ``base_resp.status_code``
    other than 0 is an error although the call itself succeeded.
    """
    parsed = F.from_json(body, EMBEDDING_RESPONSE)
    if shape == "single":
        one = F.coalesce(F.try_element_at(parsed["data"], F.lit(1))["embedding"], parsed["embedding"])
        vectors = F.when(one.isNotNull(), F.array(one))
        error = F.when(one.isNull(), F.lit(SINGLE_MISSING_TEXT))
    elif shape == "openai":
        vectors = F.coalesce(
            F.transform(parsed["data"], lambda d: d["embedding"]), F.array().cast("array<array<double>>")
        )
        error = F.lit(None).cast("string")
    elif shape == "vectors":
        code = F.coalesce(parsed["base_resp"]["status_code"], F.lit(0))
        text = F.coalesce(parsed["base_resp"]["status_msg"], F.lit(""))
        failed = code != 0
        vectors = F.when(~failed, parsed["vectors"])
        error = F.when(failed, F.concat(F.lit("model error "), code.cast("string"), F.lit(": "), text)).when(
            parsed["vectors"].isNull(), F.lit(VECTORS_MISSING_TEXT)
        )
    else:
        raise ValueError(f"unknown response shape: {shape}")
    return F.struct(vectors.alias("vectors"), error.alias("error"))
