"""Retry rules for calls to a model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Which answers are tried again, how often, and the waiting times.
RETRYABLE_STATUS = [408, 425, 429, 500, 502, 503, 504]
MAX_RETRIES = 6
INITIAL_BACKOFF_S = 2.0
MAX_BACKOFF_S = 60.0
PERMANENT_CODE = "insufficient_quota"

SUCCESS, RETRY, PERMANENT, EXHAUSTED = "success", "retry", "permanent", "exhausted"


def retry_class(
    attempt: Column, status: Column, error_code: Column | None = None, max_retries: int = MAX_RETRIES
) -> Column:
    """What follows the ``attempt``-th failure; a NULL status stands for a network error."""
    code = F.lit(None).cast("string") if error_code is None else error_code
    ok = status.between(200, 299)
    lasting = status.isNotNull() & ~status.isin(RETRYABLE_STATUS)
    return (
        F.when(F.coalesce(ok, F.lit(False)), F.lit(SUCCESS))
        .when(F.coalesce(code == PERMANENT_CODE, F.lit(False)) | lasting, F.lit(PERMANENT))
        .when(attempt > max_retries, F.lit(EXHAUSTED))
        .otherwise(F.lit(RETRY))
    )


def retry_wait(attempt: Column, status: Column, retry_after: Column | None = None) -> Column:
    """Seconds before the next try: doubling from 2 to 60, at least what the server asks for."""
    backoff = F.least(F.lit(INITIAL_BACKOFF_S) * F.pow(F.lit(2.0), attempt - 1), F.lit(MAX_BACKOFF_S))
    if retry_after is None:
        return backoff
    asked = F.when(status.isNotNull(), retry_after.try_cast("double"))
    return F.greatest(backoff, asked)


def backoff_seconds(attempt: int, retry_after: float | None = None) -> float:
    """The same waiting time for code that runs inside a task."""
    wait = min(INITIAL_BACKOFF_S * 2.0 ** (attempt - 1), MAX_BACKOFF_S)
    return wait if retry_after is None else max(wait, retry_after)
