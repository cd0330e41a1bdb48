"""Flow operators on records: routes, dead letters, retries, expiry, attributes."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.retry import EXHAUSTED, MAX_RETRIES, PERMANENT, RETRY, SUCCESS, retry_class
from corpusloom.session import materialise

# Fixed value: how long records stay in a terminal queue unless stated otherwise.
DEFAULT_TTL = "100 days"
UNMATCHED = "unmatched"
# the folders of a terminal queue
DAY = "ended_on"

Sink = Callable[[DataFrame], None]


def route(df: DataFrame, rules: dict[str, Column], unmatched: str = UNMATCHED, to_all: bool = False) -> DataFrame:
    """Adds ``route``: the first rule that holds, or one row per rule that holds with ``to_all``."""
    if unmatched in rules:
        raise ValueError(f"route name {unmatched!r} is reserved")
    holds = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    if not to_all:
        chosen = F.lit(unmatched)
        for name, rule in reversed(holds.items()):
            chosen = F.when(rule, F.lit(name)).otherwise(chosen)
        return df.withColumn("route", chosen)
    names = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in holds.items()]))
    names = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(unmatched)))
    return df.withColumn("route", F.explode(names))


def route_frames(df: DataFrame, names: list[str], unmatched: str = UNMATCHED) -> dict[str, DataFrame]:
    """One frame per route of a routed frame."""
    return {name: df.where(F.col("route") == name) for name in [*names, unmatched]}


def fan_out(df: DataFrame, sinks: dict[str, Sink]) -> None:
    """Give every sink all records; they are computed and written once, so that all sinks agree whatever executor is lost."""
    written = materialise(df, "fan-out")
    for sink in sinks.values():
        sink(written)


def with_day(df: DataFrame, ts: str) -> DataFrame:
    """Adds the day of a record's time, by which terminal queues are divided; null without a time."""
    return df.withColumn(DAY, F.to_date(ts))


def dead_letter(df: DataFrame, relationship: str, path: str, ts: str | None = None) -> None:
    """Write ended records so that every relationship has a folder of its own, and with ``ts`` every day one in it."""
    if ts is None:
        df.write.mode("append").partitionBy(relationship).parquet(path)
    else:
        with_day(df, ts).write.mode("append").partitionBy(relationship, DAY).parquet(path)


def unexpired(queue: DataFrame, ts: str, now: datetime | Column, ttl: str = DEFAULT_TTL) -> DataFrame:
    """What ``expire`` keeps of a terminal queue divided by days; days that ended before are not read."""
    if not isinstance(now, Column):
        now = F.lit(now.isoformat(sep=" ")).cast(queue.schema[ts].dataType)
    first = F.to_date(now - F.expr(f"INTERVAL {ttl}"))
    return expire(queue.where(F.col(DAY).isNull() | (F.col(DAY) >= first)), ts, now, ttl).drop(DAY)


def drop_expired(spark: SparkSession, path: str, now: datetime, ttl: timedelta) -> list[str]:
    """Delete the folders of days that are over for good in a terminal queue; their paths."""
    last = (now - ttl).date()
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dropped = []
    for folder in system.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"*=*/{DAY}=*")) or []:
        day = folder.getPath().getName().split("=", 1)[1]
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", day) and date.fromisoformat(day) < last:
            system.delete(folder.getPath(), True)
            dropped.append(folder.getPath().toString())
    return sorted(dropped)


def conservation(df_in: DataFrame, outputs: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the input and of every output, one row each; nothing may get lost."""
    counts = [df_in.agg(F.count(F.lit(1)).alias("n")).select(F.lit("input").alias("name"), "n")]
    counts += [out.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, out in outputs.items()]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result


def route_conservation(routed: DataFrame, names: list[str], unmatched: str = UNMATCHED) -> DataFrame:
    """``name, n`` of the input and of every route of a frame with one route per record, in one pass."""
    counts = [F.struct(F.lit("input").alias("name"), F.count(F.lit(1)).alias("n"))]
    counts += [F.struct(F.lit(name).alias("name"), F.count_if(F.col("route") == name).alias("n")) for name in [*names, unmatched]]
    return routed.agg(F.array(*counts).alias("counts")).select(F.explode("counts").alias("c")).select("c.name", "c.n")


def expire(df: DataFrame, ts: str, now: datetime | Column, ttl: str = DEFAULT_TTL) -> DataFrame:
    """Records that have not expired at ``now``; one without a time stays."""
    if not isinstance(now, Column):
        now = F.lit(now.isoformat(sep=" ")).cast(df.schema[ts].dataType)
    fresh = F.col(ts) > now - F.expr(f"INTERVAL {ttl}")
    return df.where(F.coalesce(fresh, F.lit(True)))


def set_attributes(df: DataFrame, values: dict[str, Column], attributes: str = "attributes") -> DataFrame:
    """Add or replace entries of the attribute map."""
    pairs = [part for name, value in values.items() for part in (F.lit(name), value.cast("string"))]
    old = F.map_filter(
        F.coalesce(F.col(attributes), F.create_map().cast("map<string,string>")),
        lambda name, _: ~name.isin(list(values)),
    )
    return df.withColumn(attributes, F.map_concat(old, F.create_map(*pairs)))


def retry_rounds(
    df: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    max_retries: int = MAX_RETRIES,
) -> DataFrame:
    """Run a step until each record succeeds or ends: adds ``attempt`` and ``outcome``.

    ``step`` adds ``status`` and, if it likes, ``error_code``; it may call a service,
    so every round is written before it is split. Only records to be retried go on,
    and the number of rounds is fixed.
    """
    pending, ended = df, []
    for attempt in range(1, max_retries + 2):
        tried = step(pending.withColumn("attempt", F.lit(attempt)))
        code = F.col("error_code") if "error_code" in tried.columns else None
        tried = tried.withColumn("outcome", retry_class(F.col("attempt"), F.col("status"), code, max_retries))
        tried = materialise(tried, f"retry-{attempt}")
        ended.append(tried.where(F.col("outcome").isin(SUCCESS, PERMANENT, EXHAUSTED)))
        pending = tried.where(F.col("outcome") == RETRY).select(*df.columns)
        if attempt > max_retries or pending.isEmpty():
            break
    result = ended[0]
    for part in ended[1:]:
        result = result.unionByName(part)
    return result
