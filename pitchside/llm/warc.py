"""Operator 4: WARC archives, and their records as a chunked table.

Writing. Each task writes archives of its own (gzip, one member per record) and
starts a new one at ``ARCHIVE_BYTES``. A payload is compressed piece by piece.
File names hold a random part, and only files in the manifest (a table Spark
commits) are read, so a task that is lost or runs twice leaves no trace.

Reading. An archive is read as a stream: records are recognised by their
``Content-Length``, whatever their payload looks like, and come as rows of
(record, chunk number) with at most ``CHUNK`` payload bytes each. Every row
carries the SHA-1 of the payload up to its end, carried on from the chunk
before; the last row of a record has the digest of all of it. No task ever
holds a whole payload or archive. The chunk table is written, with its data, and
what is said of a record comes from its last row there.

Revisits. Of pages with equal payloads (equal SHA-1 and length) of at least
``MIN_REVISIT`` bytes, the one with the largest id is written as ``response``,
the others as ``revisit`` records that refer to it. The page with the payload
is found by an aggregate of digests; pages of a hot digest are spread.

Defined results: a null payload is an empty one; a null id is smaller than any
number, and pages that all lack one are responses; rows that share the largest
id of a payload are responses all of them; smaller payloads are responses;
repeated rows are written each; an empty table gives archives without records;
other columns are not looked at. A null or odd URL is escaped, so a header
stays one line.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm.common import fresh_path, salted_left_join, ship, written

ship(__name__)

MIN_REVISIT, ARCHIVE_BYTES, CHUNK, PIECE = 1000, 256 << 20, 1 << 20, 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
CHUNKS = ("path string, record long, record_id string, record_type string, page_id long, target_uri string, refers_to string, "
          "payload_digest string, chunk long, start long, size long, data binary, sha1 string, last boolean")


def open_fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a location; a plain path or ``file:`` is a
    shared folder mounted on all machines."""
    if re.match(r"file:/|/", path):
        return pyarrow.fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return pyarrow.fs.FileSystem.from_uri(path)


def record_id(page_id: int | None, sha1: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}')}"


def head(kind: str, page_id: int | None, url: str | None, sha1: str, size: int, leader: int | None, date: str) -> bytes:
    """WARC and HTTP headers of a record; ``size`` payload bytes follow."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(size).encode() + b"\r\n\r\n")
    body = size if kind == "response" else 0
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id, sha1)}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Payload-Digest: sha1:{sha1}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + body}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{record_id(leader, sha1)}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + http


def _write(root: str, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        fs.create_dir(base, recursive=True)
        out, path, records, size, done = None, "", 0, 0, []
        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            payloads = col["payload"].cast(pa.binary())
            for i in range(batch.num_rows):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    path, out, records, size = f"{root}/{name}", fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                page, sha1, leader = (col[c][i].as_py() for c in ("page_id", "sha1", "leader"))
                payload = memoryview(payloads[i].as_buffer() or b"")
                kind = "revisit" if leader is not None and leader != page else "response"
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                size += out.write(member.compress(head(kind, page, col["url"][i].as_py(), sha1, len(payload), leader, date)))
                for at in range(0, len(payload) if kind == "response" else 0, PIECE):
                    size += out.write(member.compress(payload[at:at + PIECE]))
                size += out.write(member.compress(b"\r\n\r\n") + member.flush())
                records += 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        p, r, b = map(list, zip(*done)) if done else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(r, pa.int64()), pa.array(b, pa.int64())],
                                         names=["path", "records", "bytes"])
    return run


def write(pages: DataFrame, root: str, payload: str = "html", min_revisit: int = MIN_REVISIT, date: str = "2024-01-01T00:00:00Z",
          archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (``page_id, url`` and a text or binary payload) to WARC
    files under ``root``; returns the manifest (``path, records, bytes``)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    large = rows.filter(F.col("size") >= min_revisit)
    same = large.groupBy("sha1", "size").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # written, so that Spark knows its size: without copies the payloads are not shuffled
    same = written(same.filter(F.col("leader").isNotNull()).select("sha1", "size", "leader"), "op4-same")
    marked = salted_left_join(rows, same, ["sha1", "size"], ["page_id", "url"])
    return written(marked.select("page_id", "url", "payload", "sha1", "leader").mapInArrow(_write(root, date, archive_bytes), MANIFEST),
                   "op4-manifest")


class _Stream:
    """Decompressed bytes of a file with one gzip member per record (or none)."""

    def __init__(self, raw) -> None:
        self.raw, self.have, self.gz, self.rest, self.plain = raw, b"", None, b"", None

    def _more(self) -> bool:
        while True:
            data = self.rest or self.raw.read(PIECE)
            self.rest = b""
            if not data:
                return False
            if self.plain is None:
                self.plain = data[:2] != b"\x1f\x8b"
            if self.plain:
                self.have += data
                return True
            self.gz = self.gz or zlib.decompressobj(31)
            made = self.gz.decompress(data, PIECE)
            self.rest = self.gz.unconsumed_tail
            if self.gz.eof:
                self.rest, self.gz = self.gz.unused_data, None
            if made:
                self.have += made
                return True

    def read(self, n: int) -> bytes:
        """``n`` bytes, fewer at the end."""
        while len(self.have) < n and self._more():
            pass
        out, self.have = self.have[:n], self.have[n:]
        return out

    def some(self, most: int) -> bytes:
        if not self.have:
            self._more()
        return self.read(min(most, len(self.have)))

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while b"\r\n" not in self.have:
            if not self._more():
                return None
        out, self.have = self.have.split(b"\r\n", 1)
        return out

    def headers(self) -> dict[str, str]:
        out = {}
        while line := self.line():
            name, _, value = line.decode("utf-8").partition(":")
            out[name.strip().lower()] = value.strip()
        return out


def chunks_of(raw, chunk: int = CHUNK) -> Iterator[dict]:
    """Rows of one archive, in order."""
    stream, n = _Stream(raw), 0
    while True:
        line = stream.line()
        if line is None:
            if stream.have:
                raise ValueError("bytes after the last record")
            return
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        h = stream.headers()
        left = int(h["content-length"])
        kind = h["warc-type"]
        row = {"record": n, "record_id": h["warc-record-id"].strip("<>"), "record_type": kind,
               "page_id": int(h["x-page-id"]) if "x-page-id" in h else None, "target_uri": h.get("warc-target-uri"),
               "refers_to": h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None,
               "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None}
        if h.get("content-type", "").startswith("application/http"):
            while left:                                     # the HTTP header is not payload
                line = stream.line()
                if line is None:
                    raise ValueError("the file ends inside a record")
                left -= len(line) + 2
                if not line:
                    break
        sha1, at, k = hashlib.sha1(), 0, 0
        while True:
            parts, size = [], 0
            while size < chunk and left:
                data = stream.some(min(left, chunk - size))
                if not data:
                    raise ValueError("the file ends inside a record")
                parts.append(data)
                size, left = size + len(data), left - len(data)
                sha1.update(data)
            yield row | {"chunk": k, "start": at, "size": size, "data": b"".join(parts), "sha1": sha1.hexdigest(), "last": not left}
            at, k = at + size, k + 1
            if not left:
                break
        n += 1


def _read(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in CHUNKS.split(", ")]
        kinds = {"record": pa.int64(), "page_id": pa.int64(), "chunk": pa.int64(), "start": pa.int64(), "size": pa.int64(), "data": pa.binary(),
                 "last": pa.bool_()}

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)

        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = open_fs(path)
                with fs.open_input_stream(at, compression=None) as raw:
                    for row in chunks_of(raw, chunk):
                        rows.append(row | {"path": path})
                        size += row["size"] + 300
                        if size >= 8 << 20:
                            yield out(rows)
                            rows, size = [], 0
        yield out(rows)
    return run


def read(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives in ``manifest`` (column ``path``)."""
    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(_read(chunk), CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from the last rows of a written chunk table:
    ``record_type``, ``page_id``, ``payload_bytes`` and ``payload_digest`` of the
    full payload and ``refers_to`` (a page id). A revisit's size is that of the
    response it refers to, whose digest must be its own."""
    ends = chunks.filter("last").select("record_id", "record_type", "page_id", "refers_to", "payload_digest",
                                        (F.col("start") + F.col("size")).alias("bytes"), "sha1")
    wrong = (F.col("record_type") == "response") & (F.col("sha1") != F.col("payload_digest"))
    ends = ends.withColumn("sha1", F.when(wrong, F.raise_error(F.lit("a payload does not have its digest"))).otherwise(F.col("sha1")))
    own = ends.filter(F.col("record_type") == "response").select(
        "record_type", "page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"),
        F.lit(None).cast("long").alias("refers_to"))
    seen = ends.filter(F.col("record_type") == "revisit")
    target = ends.filter(F.col("record_type") == "response").join(seen.select(F.col("refers_to").alias("record_id")).distinct(),
                                                                  "record_id", "left_semi")
    target = target.groupBy(F.col("record_id").alias("refers_to")).agg(
        F.max("bytes").alias("_bytes"), F.max("sha1").alias("_sha1"), F.max("page_id").alias("_page"))
    found = salted_left_join(seen.drop("bytes", "sha1"), target, ["refers_to"], ["page_id"])
    lost = F.raise_error(F.lit("a revisit refers to no response with its digest"))
    found = found.select("record_type", "page_id", F.col("_bytes").alias("payload_bytes"),
                         F.when(F.col("_sha1") == F.col("payload_digest"), F.col("_sha1")).otherwise(lost).alias("payload_digest"),
                         F.col("_page").alias("refers_to"))
    return own.unionByName(found)


def digests(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back: the contract's columns."""
    manifest = write(pages, fresh_path(spark, "op4-archives"))
    return records(written(read(manifest), "op4-chunks")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
