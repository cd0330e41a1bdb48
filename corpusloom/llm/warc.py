"""WARC archives: a writer with revisit records and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import Batches, new_file, open_store, prepare, rows_to_batches, text_bytes
from corpusloom.session import broadcast_if_small, materialise, work_folder

# fixed values of the format
VERSION = b"WARC/1.1\r\n"
MANDATORY = ("warc-type", "warc-record-id", "warc-date")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

# An archive is closed once it holds this many bytes, so that one task reads it in bounded time
ARCHIVE_BYTES = 64 << 20
HEAD_BYTES = 1 << 20
_PIECE = 1 << 18
_VERSION = rb"WARC/(?:0\.1[0-9]|1\.[01])\r\n"
_GZIP = b"\x1f\x8b\x08"
_START = re.compile(re.escape(_GZIP) + rb"|" + _VERSION)
_INNER_START = re.compile(_VERSION)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def digest_bytes(named: str) -> tuple[str, bytes] | None:
    """Algorithm and digest of ``sha1:...``, in base32 or hexadecimal letters; None if it is no digest that can be checked."""
    kind, _, text = named.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size, text = hashlib.new(kind).digest_size, text.strip().rstrip("=")
    try:
        if len(text) == 2 * size:
            return kind, bytes.fromhex(text)
        return kind, base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError:
        return kind, b""


def agrees(named: str, data: bytes) -> bool:
    """Whether data have the digest that a header names; true where it names none that can be checked."""
    wanted = digest_bytes(named)
    return wanted is None or hashlib.new(wanted[0], data).digest() == wanted[1]


def payload_digest(payload: Column) -> Column:
    """Base32 of the SHA-1 of a binary column, in SQL functions: 5 hex digits give 4 letters."""
    code = F.sha1(payload)
    letters = []
    for at in range(8):
        number = F.conv(F.substring(code, 5 * at + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


@dataclass
class Record:
    """One record, or with ``reason`` a gap of bytes that could not be read.

    ``inner`` and ``inner_length`` are the place within the inflated bytes of a gzip member of several
    records or with a gap; its last row has the member's length, the others have none.
    """

    offset: int
    length: int
    reason: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None
    inner: int | None = None
    inner_length: int | None = None


def record_bytes(
    url: str, payload: bytes, digest: str, record_id: str, refers_to: str | None = None, date: str = "2020-01-01T00:00:00Z"
) -> bytes:
    """A response record, or with ``refers_to`` a revisit record, whose block keeps the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    lines = [
        f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class FileSource:
    """Random access to an archive in the shared folder."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()
        self._at, self._held = 0, b""

    def read(self, at: int, count: int) -> bytes:
        count = min(count, self.size - at)
        if not (self._at <= at and at + count <= self._at + len(self._held)):
            self._at, self._held = at, self.file.read_at(min(max(count, 4 * _PIECE), self.size - at), at)
        return self._held[at - self._at : at - self._at + count]


class BytesSource:
    """An archive that Spark has read (``binaryFile``)."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, count: int) -> bytes:
        return self.data[at : at + count]


class MemberSource:
    """The inflated bytes of a gzip member, read forwards; those before ``forget`` are dropped.

    ``end`` is where the member ends in the archive, once that is known; ``broken`` the
    reason if it cannot be inflated to its end.
    """

    def __init__(self, source, at: int):
        self.source, self.place = source, at
        self.inflate = zlib.decompressobj(31)
        self.base, self.held = 0, bytearray()
        self.end: int | None = None
        self.broken: str | None = None

    def forget(self, at: int) -> None:
        del self.held[: at - self.base]
        self.base = at

    def read(self, at: int, count: int) -> bytes:
        while self.base + len(self.held) < at + count and self.end is None and self.broken is None:
            piece = self.inflate.unconsumed_tail
            if not piece:
                piece = self.source.read(self.place, _PIECE)
                self.place += len(piece)
            try:
                made = self.inflate.decompress(piece, 4 * _PIECE)
            except zlib.error as bad:
                self.broken = f"gzip member: {str(bad).partition(': ')[2] or bad}"
                break
            self.held += made
            if self.inflate.eof:
                self.end = self.place - len(self.inflate.unused_data)
            elif not piece and not made:
                self.broken = "gzip member is cut off"
        return bytes(self.held[at - self.base : at - self.base + count])


class Damaged(Exception):
    """A failed check; ``end`` is known where the frame of the record was whole."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


def _headers(head: bytes, source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:  # folded line
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
        elif line:
            raise Damaged(f"{source} header without a colon")
    return found


def _head(data: bytes) -> tuple[dict[str, str], int, int]:
    """Headers, where the block begins, and its length."""
    if not _INNER_START.match(data):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("record header does not end")
    headers = _headers(data[:end], "record")
    if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")):
        raise Damaged("no valid Content-Length")
    if missing := [name for name in MANDATORY if name not in headers]:
        raise Damaged(f"no {', '.join(missing)}")
    return headers, end + 4, int(headers["content-length"])


def _checked(offset: int, end: int, headers: dict[str, str], block: bytes) -> Record:
    """The record, after its digests were compared."""
    record = Record(offset, end - offset, None, headers)
    if not agrees(headers.get("warc-block-digest", ""), block):
        raise Damaged("block digest differs", end)
    kind = headers.get("warc-type")
    record.payload = block
    if kind in ("response", "request", "revisit") and headers.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        if cut < 0:
            raise Damaged("HTTP header does not end", end)
        try:
            record.http = _headers(block[:cut], "HTTP")
        except Damaged as bad:
            raise Damaged(str(bad), end) from None
        record.payload = block[cut + 4 :]
    if kind != "revisit" and not agrees(headers.get("warc-payload-digest", ""), record.payload):
        raise Damaged("payload digest differs", end)
    return record


def _parse(source, at: int) -> Record:
    """The record at ``at``, which is not compressed or already inflated."""
    size = 4096
    while True:
        data = source.read(at, size)
        if b"\r\n\r\n" in data or len(data) < size or size >= HEAD_BYTES or not data.startswith(b"WARC/"):
            break
        size *= 4
    headers, begin, length = _head(data)
    end = at + begin + length + 4
    last = source.read(end - 4, 4)
    if len(last) < 4:
        raise Damaged("record is cut off, or its Content-Length is too large")
    if last != b"\r\n\r\n":
        raise Damaged("record does not end where its Content-Length says")
    return _checked(at, end, headers, source.read(at + begin, length))


def _starts(source, at: int) -> bool:
    """A member or version line that can begin a record, or the end of the source."""
    first = source.read(at, 3)
    if not first:
        return True
    try:
        if first == _GZIP and not isinstance(source, MemberSource):
            return bool(_INNER_START.match(MemberSource(source, at).read(0, 16)))
        _head(source.read(at, HEAD_BYTES))
        return True
    except Damaged:
        return False


def _next_start(source, at: int) -> int:
    """The first valid start from ``at`` on; the end of the source without one."""
    pattern = _INNER_START if isinstance(source, MemberSource) else _START
    while window := source.read(at, 4 * _PIECE):
        for match in pattern.finditer(window):
            if _starts(source, at + match.start()):
                return at + match.start()
        if len(window) <= 16 or not source.read(at + len(window), 1):
            return at + len(window)
        at += len(window) - 16  # a version line may span two windows
    return at


def _salvaged(source, at: int) -> Record:
    """The record at ``at``, or the gap up to the next start."""
    try:
        return _parse(source, at)
    except Damaged as bad:
        end = bad.end if bad.end is not None and _starts(source, bad.end) else _next_start(source, at + 1)
        return Record(at, end - at, str(bad))


def _inside(record: Record, at: int, length: int) -> Record:
    return Record(at, length, record.reason, record.headers, record.http, record.payload, record.offset, record.length)


def _member_records(source, at: int) -> Iterator[Record]:
    """The records of the gzip member at ``at``, one at a time, and gaps between them; gives the place to go on.

    An empty member has none. Of a member that cannot be inflated to its end those records stand that are followed
    by another start; the rest is one gap up to the next start behind it.
    """
    member, place, held, several = MemberSource(source, at), 0, None, False
    while member.read(place, 1):
        member.forget(place)
        found = _salvaged(member, place)
        place += found.length
        if held is not None:  # one is held back: the last row has the member's length
            several = True
            yield _inside(held, at, 0)
        held = found
    if member.broken is not None:
        end = _next_start(source, at + 1)
        yield Record(at, end - at, member.broken)
        return end
    if held is not None:
        row = _inside(held, at, member.end - at)
        if not several:
            row.inner = row.inner_length = None
        yield row
    return member.end


def salvage(source) -> Iterator[Record]:
    """All records of an archive in order; what fails a check becomes a gap.

    A record with a whole frame but a wrong digest is left out as a whole. Where the
    frame itself fails, the search goes on one byte further, for the next gzip member
    that inflates to a version line, or the next version line with a usable header. The
    same search runs over the inflated bytes of a member of several records, which are never held as a whole.
    """
    at = 0
    while at < source.size:
        if source.read(at, 3) == _GZIP:
            at = yield from _member_records(source, at)
        else:
            record = _salvaged(source, at)
            yield record
            at += record.length


def write_warc(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", compress: bool = True,
    folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """One record per row in archives below ``folder``; the manifest ``path, records, bytes``.

    Of rows with equal payloads those with the smallest key are responses, the others
    revisits of it; without any key in such a group all are responses. Null payloads
    and URLs are empty; a row with a null key gets a record id of its own. Repeated
    payloads are found by their digests alone, aggregated before the shuffle; the
    payloads are moved only if there are too many repeated ones to broadcast. The
    manifest is written by Spark, so archives of lost attempts are never read.
    """
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or work_folder(spark, "warc")
    rows = pages.select(
        F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("u"), text_bytes(payload).alias("p")
    ).withColumn("d", payload_digest(F.col("p")))
    repeated = rows.groupBy("d").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = broadcast_if_small(materialise(repeated, "repeated"))
    rows = rows.join(repeated, "d", "left").select("k", "u", "p", "d", F.when(F.col("k").isNull() | (F.col("k") != F.col("first")), F.col("first")).alias("r"))
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def archives(batches: Batches) -> Iterator[dict]:
        out, path, records, size = None, "", 0, 0
        for batch in batches:
            for k, u, p, d, r in zip(*batch.columns):
                if out is None:
                    path, out = new_file(folder, ".warc.gz" if compress else ".warc")
                k, r = k.as_py(), r.as_py()
                record_id = f"urn:uuid:{uuid.uuid4()}" if k is None else f"urn:page:{k}"
                data = record_bytes(u.as_py(), p.as_py(), d.as_py(), record_id, None if r is None else f"urn:page:{r}")
                size += out.write(gzip_member(data) if compress else data)
                records += 1
                if size >= archive_bytes:
                    out.close()
                    yield {"path": path, "records": records, "bytes": size}
                    out, records, size = None, 0, 0
        if out is not None:
            out.close()
            yield {"path": path, "records": records, "bytes": size}

    def run(batches: Batches) -> Batches:
        for row in archives(batches):
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return materialise(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "manifest")


READ_SCHEMA = (
    "path string, offset bigint, length bigint, gap string, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes bigint, payload binary, inner_offset bigint, inner_length bigint"
)


def read_warc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all archives, and a row with ``gap`` (the reason) for every quarantined run of bytes.

    ``archives`` has a ``path`` per row, opened in the tasks, or ``path`` and ``content``
    where only Spark can read the store. ``payload_bytes`` is the length of the full
    payload: of a revisit, what its HTTP head says. ``payload`` is null for gaps and
    revisits, and without ``payloads``. ``inner_offset`` and ``inner_length`` place a record or gap within a gzip
    member of several. A null path or content gives no rows. An
    archive is read by one task, a record at a time.
    """
    prepare(archives.sparkSession)
    content = "content" in archives.columns
    fields = [f.split() for f in READ_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def row(path: str, r: Record) -> tuple:
        if r.reason:
            return (path, r.offset, r.length, r.reason) + (None,) * 7 + (r.inner, r.inner_length)
        h = r.headers
        revisit = h.get("warc-type") == "revisit"
        size = r.http.get("content-length", "") if revisit else ""
        named = digest_bytes(h.get("warc-payload-digest", ""))
        digest = base64.b32encode(named[1]).decode() if named and named[0] == "sha1" else base32_sha1(r.payload)
        length = int(size) if size.isdigit() else None if revisit else len(r.payload)
        return (
            path, r.offset, r.length, None, h.get("warc-type"), h.get("warc-record-id", "").strip("<>"), h.get("warc-target-uri"),
            h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, digest, length,
            r.payload if payloads and not revisit else None, r.inner, r.inner_length,
        )

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, path in enumerate(batch.column(0).to_pylist()):
            data = batch.column(1)[i].as_py() if content else None
            if path is None or content and data is None:
                continue
            for record in salvage(BytesSource(data) if content else FileSource(path)):
                yield row(path, record)

    def run(batches: Batches) -> Batches:
        return rows_to_batches(batches, schema, rows_of)

    return archives.select("path", *["content"] * content).mapInArrow(run, READ_SCHEMA)


def read_manifest(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """``read_warc`` over a manifest, with a task per archive."""
    paths = manifest.select("path")
    return read_warc(paths.repartition(max(1, paths.count())), payloads)
