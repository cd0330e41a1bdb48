from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import warc as W


def record(i: int, payload: bytes) -> bytes:
    return W.record_bytes(f"http://x/{i}", payload, W.base32_sha1(payload), f"urn:page:{i}")


PAYLOADS = [b"<p>first</p>", b"", b"x" * 300_000, b"holds\r\nWARC/1.1\r\nnothing more", b"last"]


def archive(compress: bool) -> tuple[bytes, list[int]]:
    data, starts = b"", []
    for i, payload in enumerate(PAYLOADS):
        starts.append(len(data))
        data += W.gzip_member(record(i, payload)) if compress else record(i, payload)
    return data, starts


def read(data: bytes):
    found = list(W.salvage(W.BytesSource(data)))
    assert sum(r.length for r in found) == len(data) and [r.offset for r in found] == sorted(r.offset for r in found)
    return {int(r.headers["warc-record-id"][10:-1]): r.payload for r in found if not r.reason}, [r for r in found if r.reason]


@pytest.mark.parametrize("compress", [True, False])
def test_whole_archive(compress):
    found, gaps = read(archive(compress)[0])
    assert found == dict(enumerate(PAYLOADS)) and gaps == []


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("bad", range(len(PAYLOADS)))
def test_a_damaged_record_is_one_gap(compress, bad):
    data, starts = archive(compress)
    at = starts[bad] + 40
    data = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
    found, gaps = read(data)
    assert found == {i: p for i, p in enumerate(PAYLOADS) if i != bad} or not compress and found == dict(enumerate(PAYLOADS))
    assert [g.offset for g in gaps] == [starts[bad]] or found == dict(enumerate(PAYLOADS))


@pytest.mark.parametrize("compress", [True, False])
def test_lost_bytes_stray_bytes_and_a_cut_end(compress):
    data, starts = archive(compress)
    found, gaps = read(data[: starts[1] + 5] + data[starts[2] :])
    assert set(found) == {0, 2, 3, 4} and gaps
    found, gaps = read(data[: starts[3]] + b"garbage" + data[starts[3] :])
    assert set(found) == {0, 1, 2, 3, 4} and [(g.offset, g.length) for g in gaps] == [(starts[3], 7)]
    found, gaps = read(data[:-3])
    assert set(found) == {0, 1, 2, 3} and gaps[-1].offset == starts[4]
    assert read(b"") == ({}, [])


def test_a_wrong_digest_leaves_out_the_record_alone():
    payload = b"holds\r\n" + record(9, b"inner")
    bad = W.record_bytes("u", payload, "A" * 32, "urn:page:1")
    found, gaps = read(record(0, b"zero") + bad + record(2, b"two"))
    assert set(found) == {0, 2} and gaps[0].reason == "payload digest differs" and gaps[0].length == len(bad)


def test_members_of_several_records():
    """Whole, with damaged records inside, and cut off; members of one record stand before and behind."""
    parts = [record(i, p) for i, p in enumerate(PAYLOADS)]
    one = lambda i: W.gzip_member(record(i, b"alone"))
    found, gaps = read(one(10) + W.gzip_member(b"".join(parts)) + one(11))
    assert found == {10: b"alone", **dict(enumerate(PAYLOADS)), 11: b"alone"} and gaps == []
    broken = bytearray(b"".join([parts[0], parts[1], b"stray", parts[2].replace(b"xxxx", b"xxyx", 1), parts[3], b"junk" * 30, parts[4]]))
    data = one(10) + W.gzip_member(bytes(broken)) + one(11)
    rows = list(W.salvage(W.BytesSource(data)))
    found, gaps = read(data)
    assert set(found) == {10, 0, 1, 3, 4, 11}
    inner = [(g.inner, g.inner_length) for g in gaps]
    at = len(parts[0]) + len(parts[1])
    assert inner == [(at, 5), (at + 5, len(parts[2])), (at + 5 + len(parts[2]) + len(parts[3]), 120)]
    assert [g.reason for g in gaps] == ["no version line", "block digest differs", "no version line"]
    assert sum(r.inner_length for r in rows if r.inner is not None) == len(broken) and len({r.offset for r in rows}) == 3
    # a wrong Content-Length costs its own record alone
    wrong = parts[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    found, gaps = read(W.gzip_member(parts[0] + wrong + parts[4]))
    assert 0 in found and 4 in found and gaps
    # a member that is cut off, and one that is damaged in the middle
    whole = W.gzip_member(b"".join([parts[0], record(7, bytes(np.random.Generator(np.random.PCG64(1)).bytes(400_000))), parts[3], parts[4]]))
    found, gaps = read(one(10) + whole[: len(whole) - 200] + one(11))
    assert {10, 0, 7, 11} <= set(found) and gaps[-1].reason.startswith("gzip member")
    damaged = whole[:200_000] + bytes([whole[200_000] ^ 0xFF]) * 40 + whole[200_040:]
    found, gaps = read(one(10) + damaged + one(11))
    assert {10, 0, 11} <= set(found) and 7 not in found and gaps


def test_other_digests_and_versions():
    def with_digest(i, named, version=b"WARC/1.1"):
        return record(i, b"text").replace(b"sha1:" + W.base32_sha1(b"text").encode(), named).replace(b"WARC/1.1", version, 1)

    sha = lambda kind: f"{kind}:{hashlib.new(kind, b'text').hexdigest()}".encode()
    good = [sha("sha1"), sha("sha1").upper().replace(b"SHA1", b"sha1"), sha("sha256"), sha("md5"), b"other:xyz"]
    data = b"".join(with_digest(i, d) for i, d in enumerate(good)) + with_digest(7, good[0], b"WARC/0.18") + with_digest(8, good[0], b"WARC/1.0")
    found, gaps = read(data)
    assert set(found) == {0, 1, 2, 3, 4, 7, 8} and gaps == []
    found, gaps = read(with_digest(0, b"sha1:" + b"0" * 40) + with_digest(1, b"sha256:" + b"ab" * 32) + with_digest(2, b"sha1:not one") + with_digest(3, good[0]))
    assert set(found) == {3} and len(gaps) == 3


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, compress):
    rows = [(1, "u 1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "<p>5</p>"), (None, "u", "<p>5</p>"), (6, "u", "y" * 200_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, p string, d int")
    manifest = W.write_warc(pages, compress=compress, archive_bytes=500)
    assert manifest.agg(F.sum("records")).first()[0] == 7
    found = {(r.record_id if r.record_id.startswith("urn:page") else None): r for r in W.read_manifest(manifest).collect()}
    assert all(r.gap is None for r in found.values()) and len(found) == 7
    assert {k: (r.record_type, r.refers_to) for k, r in found.items()} == {
        "urn:page:1": ("response", None), "urn:page:2": ("revisit", "urn:page:1"), "urn:page:3": ("response", None),
        "urn:page:4": ("revisit", "urn:page:3"), "urn:page:5": ("response", None), None: ("revisit", "urn:page:5"), "urn:page:6": ("response", None),
    }
    for _, html in ((r[0], r[2]) for r in rows):
        data = (html or "").encode()
        assert any(r.payload_digest == W.base32_sha1(data) and r.payload_bytes == len(data) for r in found.values())
    assert bytes(found["urn:page:1"].payload).decode() == "<p>é</p>" and found["urn:page:2"].payload is None


def test_archives_that_only_spark_reads(spark, tmp_path):
    data, starts = archive(True)
    (tmp_path / "a.warc.gz").write_bytes(data[: starts[2]] + b"??" + data[starts[2] :])
    files = spark.read.format("binaryFile").load(str(tmp_path))
    found = W.read_warc(files).collect()
    assert sum(r.gap is None for r in found) == 5 and [r.length for r in found if r.gap] == [2]


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert W.read_manifest(W.write_warc(empty)).count() == 0


def test_native_digest(spark):
    df = spark.createDataFrame([("",), ("abc",), ("é" * 99,)], "t string")
    for r in df.select("t", W.payload_digest(F.encode("t", "UTF-8")).alias("d")).collect():
        assert r.d == W.base32_sha1(r.t.encode())
