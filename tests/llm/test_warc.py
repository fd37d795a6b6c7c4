"""Operator 4: exact round trips, chunks, revisits and edge cases."""

import hashlib
import io

import pytest

from pitchside.llm import warc
from pitchside.llm.common import fresh_path

COLUMNS = "page_id long, url string, html string, record_type string"


def digest(text):
    return hashlib.sha1((text or "").encode()).hexdigest()


def test_round_trip_and_revisits(spark):
    big, trap = "é" * 700, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" * 40
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (5, None, big), (3, "u", trap), (9, "u", trap), (4, "u", "small"), (6, "u", "small"),
            (7, "u", None), (8, "u", ""), (None, "u", big), (None, "u", "z" * 2000), (None, "v", "z" * 2000), (20, "ü ü", "\0" * 999),
            (21, "u", "\0" * 999), (22, "u", "q" * 3_000_000), (23, "u", "q" * 3_000_000), (30, "u", "t" * 1500), (30, "w", "t" * 1500)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], COLUMNS)
    root = fresh_path(spark, "w")
    manifest = warc.write(pages, root, archive_bytes=4000)
    assert sum(r.records for r in manifest.collect()) == len(rows)
    chunks = warc.read(manifest, chunk=1000).collect()
    payload = {}
    for r in sorted(chunks, key=lambda r: (r.path, r.record, r.chunk)):
        part = payload.setdefault((r.path, r.record), bytearray())
        assert r.start == len(part) and len(r.data) <= 1000
        part += r.data
        assert r.sha1 == hashlib.sha1(part).hexdigest()
    texts = {(r.page_id, bytes(payload[r.path, r.record])) for r in chunks if r.record_type == "response"}
    leader = {big: 5, trap: 9, "q" * 3_000_000: 23}
    assert texts == {(p, (t or "").encode()) for p, _, t in rows if t not in leader or leader[t] == p}
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.records(warc.read(manifest)).collect()), key=str)
    want = [(p, len((t or "").encode()), digest(t), "revisit" if t in leader and leader[t] != p else "response",
             leader[t] if t in leader and leader[t] != p else None) for p, _, t in rows]
    assert got == sorted(want, key=str)


def test_a_lost_attempt_is_not_read(spark):
    pages = spark.createDataFrame([(1, "u", "text", "x")], COLUMNS)
    root = fresh_path(spark, "w")
    manifest = warc.write(pages, root)
    warc.write(pages, root)                                   # a second run in the same folder
    assert warc.records(warc.read(manifest)).count() == 1


def test_empty_table_and_broken_files(spark):
    assert warc.digests(spark, spark.createDataFrame([], COLUMNS)).count() == 0
    good = warc.head("response", 1, "u", digest("abc"), 3, None, "2024-01-01T00:00:00Z") + b"abc\r\n\r\n"
    assert [r["data"] for r in warc.chunks_of(io.BytesIO(good * 2), 2)] == [b"ab", b"c"] * 2
    with pytest.raises(ValueError):
        list(warc.chunks_of(io.BytesIO(good[:-6])))
    with pytest.raises(ValueError):
        list(warc.chunks_of(io.BytesIO(b"not a record\r\n" + good)))


def test_a_payload_is_never_held_whole():
    """Reading takes a few chunks of memory, however large the payload."""
    import gzip
    import tracemalloc

    size = 40_000_000
    payload = bytes(size)
    raw = gzip.compress(warc.head("response", 1, "u", hashlib.sha1(payload).hexdigest(), size, None, "2024-01-01T00:00:00Z")
                        + payload + b"\r\n\r\n", 1)
    want = hashlib.sha1(payload).hexdigest()
    del payload
    tracemalloc.start()
    n = 0
    for row in warc.chunks_of(io.BytesIO(raw), 100_000):
        n += row["size"]
        assert len(row["data"]) == row["size"] <= 100_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == size and row["last"] and row["sha1"] == want and peak < 5_000_000
