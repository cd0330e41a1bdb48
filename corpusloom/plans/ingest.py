"""Corpus ingest: documents to stored documents, chunks and vectors, with a report."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.chunking import chunk_pages, running_total
from corpusloom.functions.text import CHUNK_OVERLAP, CHUNK_TOKENS, char_windows, preview, strip_ws, title
from corpusloom.functions.vectors import code_words, fit_vector, rounded_vector
from corpusloom.operators.dedup import INDEX_COLUMNS, INDEX_KEY, collision_decision, name_index
from corpusloom.operators.keys import assign_seq, stored_table
from corpusloom.operators.search import find_closest
from corpusloom.operators.stats import (
    BACKENDS, batch_totals, cost_estimate, page_stats, pinned_identity, run_report,
)
from corpusloom.operators.tables import linked
from corpusloom.plans.embedding import EmbedFn, embed_column
from corpusloom.session import BROADCAST_ROWS, broadcast_if_small, materialise
from corpusloom.sources.files import NO_TEXT, name_columns
from corpusloom.sources.schema import preflight

NO_CHUNKS = "no chunks produced"
DEFAULT_BACKEND, DEFAULT_MODEL = "openai", "text-embedding-3-large"
CALL_SIZES = {name: size for name, _, _, size, _ in BACKENDS}

DOCUMENT_COLUMNS = (
    "id bigint, filename string, source_path string, metadata struct<title: string, page_count: int, "
    "chunk_count: bigint, embed_backend: string, embed_model: string, embed_dims: int, chunk_tokens: int, "
    "chunk_overlap: int, file_size: bigint, mtime: double, sha256: string>"
)
RANGE_COLUMNS = "first_document bigint, last_document bigint, first_chunk bigint, last_chunk bigint, stream string, batch bigint"
# buckets of the name index; a corpus keeps the number that it began with
NAME_BUCKETS = 16
CHUNK_COLUMNS = (
    "id bigint, document_id bigint, chunk_index int, content string, token_count int, "
    "metadata struct<page: int>, embedding array<float>, code array<bigint>"
)


@dataclass
class Corpus:
    """Where the two tables of a corpus are stored."""

    spark: SparkSession
    path: str

    @property
    def documents_path(self) -> str:
        return f"{self.path}/documents"

    @property
    def chunks_path(self) -> str:
        return f"{self.path}/chunks"

    def is_new(self) -> bool:
        """Whether no document was ever committed."""
        return stored_table(self.spark, self.documents_path) is None

    def documents(self) -> DataFrame:
        """Committed documents; empty before the first ingest."""
        stored = stored_table(self.spark, self.documents_path)
        return self.spark.createDataFrame([], DOCUMENT_COLUMNS) if stored is None else stored

    def raw_chunks(self) -> DataFrame:
        """All written chunks, also those of documents that were never committed."""
        stored = stored_table(self.spark, self.chunks_path)
        return self.spark.createDataFrame([], CHUNK_COLUMNS) if stored is None else stored

    def chunks(self) -> DataFrame:
        """Chunks of committed documents."""
        committed = broadcast_if_small(self.documents().select(F.col("id").alias("committed_id")))
        return linked(self.raw_chunks(), "document_id", committed, "committed_id").drop("committed_id")

    def fingerprints(self) -> DataFrame:
        """``id, filename, fingerprint`` of the stored documents."""
        meta = F.col("metadata")
        names = ("file_size", "mtime", "sha256")
        return self.documents().select("id", "filename", F.struct(*[meta[n].alias(n) for n in names]).alias("fingerprint"))

    def pinned(self) -> DataFrame:
        """One row with the back end and model of the corpus, none if it is new."""
        meta = F.col("metadata")
        named = self.documents().select("id", meta["embed_backend"].alias("embed_backend"), meta["embed_model"].alias("embed_model"))
        return pinned_identity(named)

    def dims(self) -> int | None:
        """The dimension of the first stored document's vectors."""
        known = self.documents().select("id", F.col("metadata")["embed_dims"].alias("n")).where("n is not null")
        return known.agg(F.min_by("n", "id").alias("n")).first()["n"]

    @property
    def codes_path(self) -> str:
        return f"{self.path}/codes"

    @property
    def ranges_path(self) -> str:
        return f"{self.path}/ranges"

    def codes(self) -> DataFrame:
        """The code table of all committed chunks, stored by the ingest with a folder per number of set bits."""
        committed = self.documents().select(F.col("id").alias("document_id"))
        stored = stored_table(self.spark, self.codes_path)
        if stored is None:
            stored = code_table(self.raw_chunks())
        return stored.join(committed, "document_id", "left_semi").drop("document_id")

    def find_closest(self, query: list[float], k: int | None = 5, rerank_factor: int | None = 4) -> DataFrame:
        """The chunks closest to a query vector, by the stored codes."""
        return find_closest(self.chunks().drop("code"), "id", "embedding", query, k, rerank_factor, self.codes())

    def ranges(self) -> DataFrame:
        """The ids that runs have taken, one row a run, whether it ended or died."""
        stored = stored_table(self.spark, self.ranges_path)
        return self.spark.createDataFrame([], RANGE_COLUMNS) if stored is None else stored

    def reserve(self, documents: int, chunks: int, source: tuple[str | None, int | None] = (None, None)) -> tuple[int, int]:
        """Take ids for a run's documents and chunks, for good; the first of each. Neither table is scanned for it.

        ``source`` names the stream and batch that the run belongs to.
        """
        last = self.ranges().agg(F.max("last_document").alias("d"), F.max("last_chunk").alias("c")).first()
        document, chunk = (last["d"] or 0) + 1, (last["c"] or 0) + 1
        row = (document, document + documents - 1, chunk, chunk + chunks - 1, *source)
        self.spark.createDataFrame([row], RANGE_COLUMNS).coalesce(1).write.mode("append").parquet(self.ranges_path)
        return document, chunk

    def _names(self) -> str:
        """The session's name for the index: files at the corpus's path, in buckets of name and probe."""
        path = f"{self.path}/names"
        name = f"corpusloom_names_{zlib.crc32(path.encode()):08x}"
        if not self.spark.catalog.tableExists(name):
            quoted = path.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(
                f"CREATE TABLE {name} ({INDEX_COLUMNS}, run bigint) USING parquet "
                f"CLUSTERED BY ({', '.join(INDEX_KEY)}) INTO {NAME_BUCKETS} BUCKETS LOCATION '{quoted}'"
            )
        return name

    def _indexed(self, run: int) -> DataFrame:
        """Index entries of the committed documents of a run, named by its first document."""
        row = self.ranges().where(F.col("first_document") == run).first()
        own = self.fingerprints().where(F.col("id").between(row["first_document"], row["last_document"]))
        return name_index(own).withColumn("run", F.lit(run).cast("bigint"))

    def add_names(self, run: int) -> None:
        """Store the index entries of a run's committed documents; doing it again after a crash changes no answer."""
        self._indexed(run).repartition(NAME_BUCKETS, *INDEX_KEY).write.insertInto(self._names())
        self.spark.createDataFrame([(run,)], "run bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/indexed")

    def index(self, known: tuple[str, int] | None = None) -> DataFrame:
        """The name index of all committed documents: the stored one, and entries of runs that died before they added theirs.

        With ``known``, a stream and its batch, runs of the stream's other batches are left out; where no
        others are, the stored index is not read.
        """
        done = stored_table(self.spark, f"{self.path}/indexed")
        stored = {row["run"] for row in done.collect()} if done is not None else set()
        every = self.ranges().select("first_document", "stream", "batch").collect()
        runs = [r["first_document"] for r in every if known is None or r["stream"] != known[0] or r["batch"] == known[1]]
        index = self.spark.createDataFrame([], f"{INDEX_COLUMNS}, run bigint")
        if stored.intersection(runs):
            self.spark.catalog.refreshTable(self._names())
            index = self.spark.table(self._names())
            if len(runs) < len(every):
                index = index.where(F.col("run").isin(sorted(stored.intersection(runs))))
        for run in runs:
            if run not in stored:
                index = index.unionByName(self._indexed(run))
        return index

    def compacted(self, path: str) -> "Corpus":
        """A copy without the chunks of documents that were never committed, at a new path; one run with one index."""
        other = Corpus(self.spark, path)
        self.chunks().write.parquet(other.chunks_path)
        _write_codes(code_table(other.raw_chunks()), other.codes_path)
        last = self.ranges().agg(F.max("last_document").alias("d"), F.max("last_chunk").alias("c")).first()
        self.spark.createDataFrame([(1, last["d"] or 0, 1, last["c"] or 0, None, None)], RANGE_COLUMNS).coalesce(1).write.parquet(other.ranges_path)
        self.documents().write.parquet(other.documents_path)
        other.add_names(1)
        return other

    def check(self) -> None:
        """An error with all problems if the stored tables are not those that an ingest writes."""
        if self.is_new():
            return
        required = {"documents": DOCUMENT_COLUMNS, "chunks": CHUNK_COLUMNS}
        present = {"documents": self.documents().schema, "chunks": self.raw_chunks().schema}
        need = {name: self.spark.createDataFrame([], columns).schema for name, columns in required.items()}
        problems = preflight(self.spark, need, present).collect()
        if problems:
            raise ValueError("; ".join(f"{p['table']}.{p['column']}: {p['problem']}" for p in problems))


@dataclass
class Settings:
    """How an ingest works."""

    windows: Callable[[Column], Column] = char_windows
    token_count: Callable[[Column], Column] | None = None
    skip_existing: bool = False
    collision_policy: str = "fingerprint"
    backend: str | None = None
    model: str | None = None
    title_override: str | None = None
    batch_size: int | None = None
    embed_tasks: int | None = None
    dims: int | None = None
    dims_mode: str = "exact"

    def call_size(self) -> int:
        """Texts per model call: as told, else what the back end takes."""
        return self.batch_size or CALL_SIZES.get(self.backend or DEFAULT_BACKEND, 1)

    def resolved(self, pinned: tuple[str, str] | None = None) -> "Settings":
        """With a back end and a model: the given ones, else those of the corpus, else the defaults.

        A model or back end other than the corpus's is an error.
        """
        backend, model = pinned or (DEFAULT_BACKEND, DEFAULT_MODEL)
        told = replace(self, backend=self.backend or backend, model=self.model or model)
        if pinned and (told.backend, told.model) != pinned:
            raise ValueError(
                f"this corpus was embedded with {backend}/{model}; {told.backend}/{told.model} would mix vector spaces"
            )
        return told


@dataclass
class Prepared:
    """Phase 1 of an ingest, still lazy."""

    kept: DataFrame
    chunks: DataFrame
    outcomes: DataFrame
    settings: Settings = field(repr=False)

    def totals(self) -> DataFrame:
        """One row with documents, chunks and tokens of the batch."""
        return batch_totals(self.chunks, "source_path", self.settings.token_count)


def prepare(
    documents: DataFrame, settings: Settings, corpus: Corpus | None = None, write: bool = False, index: DataFrame | None = None
) -> Prepared:
    """Chunk documents and decide which to keep.

    ``documents`` has ``source_path`` (unique), ``filename``, ``fingerprint``, ``pages``
    and ``error`` (NULL if the pages could be read). Without a look at stored documents
    all of it is row by row. With ``write``, page texts and decisions are written
    once, so files are opened and names compared a single time.
    """
    sized = page_stats(documents)
    blank = ~F.exists("pages", lambda p: F.coalesce(strip_ws(p) != "", F.lit(False)))
    error = F.coalesce(
        F.col("error"), F.when(F.col("total_chars") == 0, NO_TEXT), F.when(blank, NO_CHUNKS)
    )
    read = sized.withColumn("error", error)
    if write:
        read = materialise(read, "pages")
    outcomes = read.where(F.col("error").isNotNull()).select(
        F.lit("parse_failed").alias("status"), "source_path", F.col("filename").alias("file"), F.col("error").alias("detail")
    )
    kept = read.where(F.col("error").isNull()).drop("error")
    if settings.skip_existing and corpus is not None and not corpus.is_new():
        decided = collision_decision(
            kept.select("source_path", "filename", "fingerprint"), corpus.index() if index is None else index, settings.collision_policy
        )
        if write:
            decided = materialise(decided, "decisions")
        if settings.collision_policy.lower() == "fail":
            hit = decided.where(F.col("decision") == "abort").orderBy("filename").limit(1).collect()
            if hit:
                raise ValueError(f"{hit[0]['filename']}: {hit[0]['reason']}")
        kept = _chosen(kept, decided, write)
        skipped = decided.where(F.col("decision") != "keep").select(
            F.lit("skipped").alias("status"), "source_path", F.col("filename").alias("file"), F.col("reason").alias("detail")
        )
        outcomes = outcomes.unionByName(skipped)
    chunks = chunk_pages(kept.select("source_path", "pages"), windows=settings.windows)
    return Prepared(kept, chunks, outcomes, settings)


def _chosen(documents: DataFrame, decided: DataFrame, written: bool) -> DataFrame:
    """The documents that are decided to be kept.

    Where decisions are written they are counted first: if one side is empty or small, the page texts stay where they are.
    """
    keep = F.col("decision") == "keep"
    chosen, others = decided.where(keep).select("source_path"), decided.where(~keep).select("source_path")
    if written:
        n = decided.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("others")).first()
        if not n["kept"]:
            return documents.limit(0)
        if not n["others"]:
            return documents
        if n["others"] <= min(n["kept"], BROADCAST_ROWS):
            return documents.join(F.broadcast(others), "source_path", "left_anti")
        if n["kept"] <= BROADCAST_ROWS:
            return documents.join(F.broadcast(chosen), "source_path", "left_semi")
    return documents.join(chosen, "source_path", "left_semi")


def dry_run(prepared: Prepared) -> DataFrame:
    """Totals of the batch and the shortened first chunk of its first document."""
    order = F.struct(F.lower("filename"), "filename", "source_path")
    first = prepared.kept.agg(F.min_by("source_path", order).alias("source_path")).scalar()
    sample = F.struct("chunk_index", "page", preview(F.col("content")).alias("content"))
    chunk = (
        prepared.chunks.where((F.col("source_path") == first) & (F.col("chunk_index") == 0)).select(sample).scalar()
    )
    return prepared.totals().select("documents", "total_chunks", "total_tokens", chunk.alias("sample_chunk"))


def estimate(prepared: Prepared) -> DataFrame:
    """Totals of the batch and what its vectors would cost."""
    return cost_estimate(prepared.totals(), prepared.settings.backend, prepared.settings.model)


DIMS_MODES = ("exact", "pad_strict", "fit")


def with_dims(vectors: DataFrame, dims: int | None, mode: str) -> DataFrame:
    """Vectors of the column's dimension; a chunk whose vector cannot get it has an ``embed_error`` instead.

    ``exact`` takes vectors of that dimension only, ``pad_strict`` fills shorter ones with
    zeros, ``fit`` also cuts longer ones.
    """
    if mode not in DIMS_MODES:
        raise ValueError(f"unknown dims_mode: {mode}")
    if dims is None:
        return vectors
    vector, size = F.col("embedding"), F.size("embedding")
    bad = {"exact": size != dims, "pad_strict": size > dims, "fit": F.lit(False)}[mode] & vector.isNotNull()
    error = F.when(bad, F.format_string(f"embedding has %d dims, expected {dims}", size))
    return vectors.withColumns({
        "embed_error": F.coalesce("embed_error", error), "embedding": F.when(~bad, fit_vector(vector, dims)),
    })


def _by_name() -> list[Column]:
    """The order in which documents are numbered."""
    return name_columns("filename", "source_path")


def _first_dims(vectors: DataFrame, kept: DataFrame) -> int | None:
    """The size of the first vector of the first document by name that has one."""
    first = vectors.where("embedding is not null").groupBy("source_path").agg(F.min_by(F.size("embedding"), "chunk_index").alias("n"))
    return kept.select("source_path", "filename").join(first, "source_path").agg(F.min_by("n", F.struct(*_by_name())).alias("n")).first()["n"]


def code_table(chunks: DataFrame) -> DataFrame:
    """``id, document_id, w0 ..., bits`` of chunks that have a code; ``bits`` are the set ones."""
    stored = chunks.where(F.col("code").isNotNull())
    words = stored.limit(1).agg(F.max(F.size("code")).alias("n")).first()["n"] or 0
    bits = F.aggregate("code", F.lit(0), lambda total, word: total + F.bit_count(word)).alias("bits")
    return stored.select("id", "document_id", *[F.col("code")[i].alias(f"w{i}") for i in range(words)], bits)


def _write_codes(codes: DataFrame, path: str) -> None:
    codes.repartitionByRange("bits", "id").write.mode("append").partitionBy("bits").parquet(path)


def ready(settings: Settings, corpus: Corpus) -> Settings:
    """The settings of a run, or an error, before any file is opened: the tables, the pinned model, the dimension."""
    corpus.check()
    if settings.dims_mode not in DIMS_MODES:
        raise ValueError(f"unknown dims_mode: {settings.dims_mode}")
    pin = corpus.pinned().collect()
    settings = settings.resolved((pin[0]["embed_backend"], pin[0]["embed_model"]) if pin else None)
    return replace(settings, dims=settings.dims or corpus.dims())


@dataclass
class Report:
    """Outcome rows ``status, source_path, file, detail`` and their one-row summary."""

    outcomes: DataFrame
    summary: DataFrame


def run(prepared: Prepared, corpus: Corpus, embed: EmbedFn, source: tuple[str | None, int | None] = (None, None)) -> Report:
    """Embed and store the kept documents.

    Vectors are written once, before anything depends on them. Chunks are stored
    first and documents last: a document row is the commit, so readers never see a
    document without all its chunks. A document with a failed call stores nothing.
    """
    settings = prepared.settings
    vectors = materialise(
        embed_column(
            prepared.chunks, "content", embed, settings.call_size(), "source_path", "chunk_index", settings.embed_tasks
        ),
        "vectors",
    )
    dims = settings.dims or _first_dims(vectors, prepared.kept)
    vectors = with_dims(vectors, dims, settings.dims_mode)
    per_doc = vectors.groupBy("source_path").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.min("embed_error").alias("embed_error"),
        F.max(F.size("embedding")).alias("embed_dims"),
    )
    embedded = materialise(prepared.kept.drop("pages").join(per_doc, "source_path"), "embedded")
    failed = embedded.where(F.col("embed_error").isNotNull()).select(
        F.lit("ingest_failed").alias("status"), "source_path", F.col("filename").alias("file"),
        F.col("embed_error").alias("detail"),
    )
    good = embedded.where(F.col("embed_error").isNull())
    size = good.agg(F.count(F.lit(1)).alias("documents"), F.sum("chunk_count").alias("chunks")).first()
    if not size["documents"]:
        everything = prepared.outcomes.unionByName(failed)
        return Report(everything, run_report(everything))
    # ids are taken before anything is stored under them, and not given out again
    first_id, first_of_all = corpus.reserve(size["documents"], size["chunks"], source)
    numbered = assign_seq(good, "id", _by_name(), first_id)
    fp = F.col("fingerprint")
    # a title is given to a single file only
    single = settings.title_override is not None and prepared.kept.limit(2).count() + prepared.outcomes.limit(2).count() == 1
    override = F.lit(settings.title_override) if single else None
    rows = numbered.select(
        "id",
        "filename",
        "source_path",
        F.struct(
            title(F.col("filename"), override).alias("title"),
            F.col("page_count").cast("int").alias("page_count"),
            "chunk_count",
            F.lit(settings.backend).alias("embed_backend"),
            F.lit(settings.model).alias("embed_model"),
            "embed_dims",
            F.lit(CHUNK_TOKENS).alias("chunk_tokens"),
            F.lit(CHUNK_OVERLAP).alias("chunk_overlap"),
            fp["file_size"].alias("file_size"),
            fp["mtime"].alias("mtime"),
            fp["sha256"].alias("sha256"),
        ).alias("metadata"),
    )
    # a chunk id is its document's first id plus its index: chunks need no sort
    starts = running_total(numbered.select("source_path", "id", "chunk_count"), [], "id", "chunk_count", "_before")
    first_chunk = F.col("_before") + first_of_all
    starts = starts.select("source_path", F.col("id").alias("document_id"), first_chunk.alias("_first"))
    if size["documents"] <= BROADCAST_ROWS:
        # else chunks are shuffled with their texts, as soon as paths outgrow the threshold of Spark's own broadcasts
        starts = F.broadcast(starts)
    count = settings.token_count or (lambda _: F.lit(None))
    numbered_chunks = vectors.join(starts, "source_path").select(
        (F.col("_first") + F.col("chunk_index")).alias("id"),
        "document_id",
        "chunk_index",
        "content",
        count(F.col("content")).cast("int").alias("token_count"),
        F.struct("page").alias("metadata"),
        rounded_vector(F.col("embedding")).alias("embedding"),
        (F.array(*code_words(rounded_vector(F.col("embedding")), dims)) if dims else F.lit(None).cast("array<bigint>")).alias("code"),
    )
    # searches fetch chunks by id: a Bloom filter lets them pass over the other row groups
    writer = numbered_chunks.write.mode("append").option("parquet.bloom.filter.enabled#id", "true")
    writer.parquet(corpus.chunks_path)
    if dims:
        last = first_of_all + size["chunks"] - 1
        _write_codes(code_table(corpus.raw_chunks().where(F.col("id").between(first_of_all, last))), corpus.codes_path)
    rows.write.mode("append").parquet(corpus.documents_path)
    corpus.add_names(first_id)
    succeeded = rows.select(
        F.lit("succeeded").alias("status"), "source_path", F.col("filename").alias("file"),
        F.concat(F.lit("document_id="), F.col("id").cast("string")).alias("detail"),
    )
    everything = prepared.outcomes.unionByName(failed).unionByName(succeeded)
    return Report(everything, run_report(everything))


def ingest(
    documents: DataFrame,
    settings: Settings,
    corpus: Corpus | None = None,
    embed: EmbedFn | None = None,
    mode: str = "full",
    index: DataFrame | None = None,
    source: tuple[str | None, int | None] = (None, None),
) -> Report | DataFrame:
    """Ingest extracted documents; ``dry_run`` and ``estimate`` only report.

    Tables, pinned model and dimension are checked before a document is looked at. ``index`` stands
    for the corpus's own name index, ``source`` names the stream and batch that the documents come from.
    """
    if mode not in ("full", "dry_run", "estimate"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "full" and (corpus is None or embed is None):
        raise ValueError("a full run needs a corpus and a model function")
    settings = settings.resolved() if corpus is None else ready(settings, corpus)
    if mode == "dry_run":
        return dry_run(prepare(documents, settings, corpus))
    if mode == "estimate":
        return estimate(prepare(documents, settings, corpus))
    return run(prepare(documents, settings, corpus, True, index), corpus, embed, source)
