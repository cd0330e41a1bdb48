"""Flow operators on streams; each micro-batch goes through the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.text import file_name
from corpusloom.functions.retry import retry_class, retry_wait
from corpusloom.operators.flow import DAY, UNMATCHED, route, set_attributes, with_day
from corpusloom.plans.ingest import Corpus, Report, Settings, ingest
from corpusloom.plans.embedding import EmbedFn
from corpusloom.session import materialise
from corpusloom.sources.files import FILE_SCHEMA, Extractor, _glob, extract_pages, read_documents, read_files

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# files of one micro-batch of an ingest, whose paths come to the driver
BATCH_FILES = 10_000

Sink = Callable[[DataFrame, int], None]


def folder_sink(path: str, partition_by: str | None = None) -> Sink:
    """A sink that may see a batch again after a failure and then replaces it.

    Every batch has a folder of its own, named by its number.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batch.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{path}/batch_id={batch_id}")

    return write


def fan_out_stream(
    stream: DataFrame, sinks: dict[str, Sink], checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Give every sink all records of every batch; a batch is computed once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        written = materialise(batch, "fan-out")
        for sink in sinks.values():
            sink(written, batch_id)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def route_stream(
    stream: DataFrame,
    rules: dict[str, Column],
    path: str,
    checkpoint: str,
    unmatched: str = UNMATCHED,
    available_now: bool = True,
) -> StreamingQuery:
    """Route records into one folder per route, exactly once (file sink)."""
    writer = (
        route(stream, rules, unmatched)
        .writeStream.format("parquet")
        .partitionBy("route")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def dead_letter_stream(stream: DataFrame, relationship: str, ts: str, path: str, checkpoint: str) -> StreamingQuery:
    """Ended records into the terminal queue of ``dead_letter``: a folder per relationship and day, exactly once (file sink)."""
    writer = with_day(stream, ts).writeStream.format("parquet").partitionBy(relationship, DAY)
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_stream(stream: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """The first record of every key; keys are remembered for ``delay`` of event time."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need a zoned time
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def retry_stream(
    work: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    retry_path: str,
    done: Sink,
    ended: Sink,
    checkpoint: str,
    now: Column | None = None,
    key: list[str] | None = None,
) -> StreamingQuery:
    """One pass of a retry loop over records with an ``attempt`` column (1 for new ones).

    Records to be retried go, with ``attempt`` raised and a time ``not_before``, to the
    retry table, which ``work`` may read as a source too. With ``key``, a record that comes back too
    early waits in state until it is due, so it is written once per attempt; without, it is put
    into the table again. Success and lasting failure have sinks of their own.
    """
    now = F.current_timestamp() if now is None else now
    if key is not None:
        work = wait_until_due(work, key)

    def each(batch: DataFrame, batch_id: int) -> None:
        early = batch.limit(0)
        if "not_before" in batch.columns and key is None:
            due = F.coalesce(F.col("not_before") <= now, F.lit(True))
            early, batch = batch.where(~due), batch.where(due)
        tried = step(batch)
        code = F.col("error_code") if "error_code" in tried.columns else None
        after = F.col("retry_after") if "retry_after" in tried.columns else None
        judged = tried.withColumn("outcome", retry_class(F.col("attempt"), F.col("status"), code))
        # the step may call a service: it is written before it is split
        judged = materialise(judged, "retry")
        done(judged.where(F.col("outcome") == "success"), batch_id)
        ended(judged.where(F.col("outcome").isin("permanent", "exhausted")), batch_id)
        wait = F.make_dt_interval(secs=retry_wait(F.col("attempt"), F.col("status"), after).cast("decimal(18,6)"))
        again = judged.where(F.col("outcome") == "retry").withColumns(
            {"not_before": now + wait, "attempt": F.col("attempt") + 1}
        )
        folder_sink(retry_path)(again.unionByName(early, allowMissingColumns=True), batch_id)

    # a query with timers would run batches without data for ever, and never end
    conf, name = work.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false" if key is not None else before)
    try:
        return (
            work.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(each)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(name, before)


def wait_until_due(stream: DataFrame, key: list[str], due: str = "not_before") -> DataFrame:
    """Records when they are due: early ones wait in keyed state until a timer of their key fires.

    Times are compared with the clock of the micro-batch. A record without a time is due at once. In a
    query that ends when no data are left, timers fire in batches with data, so in its next run at the latest. Records of
    one key come out together when the last of them is due, so keys should name records.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def hold(_key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield held[0]
            return
        held += [part for part in parts if len(part)]
        rows = pd.concat(held, ignore_index=True) if held else None
        if rows is None:
            return
        last = rows["_due"].dropna()
        wait = int(last.max()) - state.getCurrentProcessingTimeMs() if len(last) else 0
        if wait <= 0:
            if state.exists:
                state.remove()
            yield rows
            return
        sink = pa.BufferOutputStream()
        table = pa.Table.from_pandas(rows, preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
        state.setTimeoutDuration(wait)

    timed = stream.withColumn("_due", F.unix_millis(F.col(due).cast("timestamp")))
    return timed.groupBy(*key).applyInPandasWithState(
        hold, timed.schema, "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout
    ).drop("_due")


def record_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """Records that arrive as parquet files in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def file_stream(spark: SparkSession, folder: str, ext: str = "pdf", most: int | None = None) -> DataFrame:
    """Files that arrive in a folder, with their contents; at most ``most`` of them a batch."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", _glob(ext))
    return (reader.option("maxFilesPerTrigger", most) if most else reader).load(folder)


def first_seen(stream: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``seen``: whether a record of the same key came before, in this batch or an earlier one.

    Keys are remembered for good, in RocksDB, which is not bounded by an executor's memory.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = T.StructType([*stream.schema.fields, T.StructField("seen", T.BooleanType())])

    def mark(_key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.exists
        for part in parts:
            yield part.assign(seen=[known or i > 0 for i in range(len(part))])
            known = known or len(part) > 0
        state.update((True,))

    return stream.groupBy(*key).applyInPandasWithState(mark, schema, "known boolean", "append", GroupStateTimeout.NoTimeout)


def file_attributes(files: DataFrame) -> DataFrame:
    """Adds the attribute map with ``absolute.path`` and ``filename`` to a file stream."""
    empty = files.withColumn("attributes", F.create_map().cast("map<string,string>"))
    return set_attributes(
        empty,
        {
            "absolute.path": F.regexp_replace("path", "/[^/]*$", ""),
            "filename": F.regexp_extract("path", "([^/]*)$", 1),
        },
    )


def stream_ingest(
    spark: SparkSession,
    folder: str,
    extractor: Extractor,
    corpus: Corpus,
    embed: EmbedFn,
    settings: Settings,
    checkpoint: str,
    ext: str = "pdf",
    on_report: Callable[[Report], None] | None = None,
    batch_files: int = BATCH_FILES,
) -> StreamingQuery:
    """Ingest files as they arrive, with the steps of the batch ingest.

    Stored files are always skipped by fingerprint. Names and digests of all files that came
    are kept as state, so a batch of files that were never seen does not look at the
    corpus, however large it has grown; only where one was seen, or others write to the
    corpus too, are files looked up in the name index. A batch that runs again after a
    failure finds the documents it had stored and adds only the others.
    """

    if settings.collision_policy.lower() != "fingerprint":
        raise ValueError(f"a stream is ingested with policy fingerprint, not {settings.collision_policy}")
    settings = replace(settings, skip_existing=True)
    stream = checkpoint.rstrip("/")
    files = file_stream(spark, folder, ext, batch_files)
    arrivals = first_seen(
        files.select("path", file_name(F.col("path")).alias("filename"), F.sha2("content", 256).alias("sha256")), ["filename", "sha256"]
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        arrived = batch.select("path", "seen").collect()  # at most batch_files rows without their contents
        if not arrived:
            return
        documents = extract_pages(read_documents(read_files(spark, [row["path"] for row in arrived])), extractor)
        index = corpus.index(None if any(row["seen"] for row in arrived) else (stream, batch_id))
        report = ingest(documents, settings, corpus, embed, index=index, source=(stream, batch_id))
        if on_report:
            on_report(report)

    return (
        arrivals.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(each)
        .trigger(availableNow=True)
        .start()
    )
