"""Attaching vectors to texts through an injected model function."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from corpusloom.functions.retry import MAX_RETRIES, PERMANENT_CODE, RETRYABLE_STATUS, backoff_seconds
from corpusloom.session import bounded_batches

EmbedFn = Callable[[list[str]], list[list[float]]]


class ModelError(Exception):
    """A failed model call: HTTP status (None for a network error), code and retry-after seconds."""

    def __init__(self, message: str, status: int | None = None, code: str | None = None, retry_after: float | None = None):
        super().__init__(message)
        self.status, self.code, self.retry_after = status, code, retry_after

    @property
    def lasting(self) -> bool:
        return self.code == PERMANENT_CODE or (self.status is not None and self.status not in RETRYABLE_STATUS)


def call_model(embed: EmbedFn, texts: list[str], sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """One model call with retries; the answer must hold one vector per text."""
    attempt = 0
    while True:
        try:
            vectors = embed(texts)
            break
        except ModelError as failure:
            attempt += 1
            if failure.lasting or attempt > MAX_RETRIES:
                raise
            sleep(backoff_seconds(attempt, failure.retry_after))
    if len(vectors) != len(texts):
        raise ModelError(f"embedding count mismatch {len(vectors)} vs {len(texts)}", status=200)
    return vectors


def embed_column(
    df: DataFrame,
    text: str,
    embed: EmbedFn,
    batch_size: int = 64,
    group: str | None = None,
    position: str | None = None,
    tasks: int | None = None,
    out: str = "embedding",
) -> DataFrame:
    """Adds ``out`` (array<float>) and ``embed_error``.

    With ``group`` and ``position`` (0-based and dense in the group) a call holds
    texts of one group only, in order, so a failing call fails that group alone. Rows
    are spread by group and call number: a huge document is shared by many tasks.
    ``tasks`` bounds the number of parallel callers. The result should be written
    before it is used twice, or the model is called twice.
    """
    schema = T.StructType(
        df.schema.fields
        + [T.StructField(out, T.ArrayType(T.FloatType(), False)), T.StructField("embed_error", T.StringType())]
    )
    bounded_batches(df.sparkSession)
    call = "_call"
    if group:
        rows = df.withColumn(call, F.floor(F.col(position) / batch_size))
        spread = [F.col(group), F.col(call)]
        rows = rows.repartition(tasks, *spread) if tasks else rows.repartition(*spread)
        rows = rows.sortWithinPartitions(group, call, position)
    else:
        rows = df.withColumn(call, F.lit(0))
        rows = rows.repartition(tasks) if tasks else rows

    def embed_rows(rows: pd.DataFrame, ends: list[int]) -> pd.DataFrame:
        """Rows with their vectors; ``ends`` are the positions where a call ends."""
        texts, vectors, errors, start = rows[text].tolist(), [], [], 0
        for end in ends:
            part = texts[start:end]
            try:
                vectors += call_model(embed, part)
                errors += [None] * len(part)
            except Exception as failure:  # recorded in the rows, the job goes on
                vectors += [None] * len(part)
                errors += [f"{type(failure).__name__}: {failure}"] * len(part)
            start = end
        return rows.drop(columns=[call]).assign(**{out: vectors, "embed_error": errors})

    def call_ends(rows: pd.DataFrame) -> list[int]:
        keys = [group, call] if group else [call]
        fresh = (rows[keys] != rows[keys].shift()).any(axis=1).to_numpy()
        ends, length = [], 0
        for at, new in enumerate(fresh):
            if length and (new or length == batch_size):
                ends.append(at)
                length = 0
            length += 1
        return ends + [len(rows)] if length else ends

    def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the last call may go on in the next batch
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            ends = call_ends(rows)
            if len(ends) > 1:
                yield embed_rows(rows.iloc[: ends[-2]], ends[:-1])
                rows = rows.iloc[ends[-2] :].reset_index(drop=True)
            held = rows
        if held is not None and len(held):
            yield embed_rows(held, call_ends(held))

    return rows.mapInPandas(calls, schema)


def digest_embedder(dims: int = 8) -> EmbedFn:
    """A model stand-in without a network: component i is byte i of the MD5 digest, minus 127.5."""
    if not 1 <= dims <= 16:
        raise ValueError("dims must be between 1 and 16")

    def embed(texts: list[str]) -> list[list[float]]:
        digests = (hashlib.md5(text.encode("utf-8")).digest() for text in texts)
        return [[byte - 127.5 for byte in digest[:dims]] for digest in digests]

    return embed
