"""Operator 13: lines that other documents have too, by two Bloom filters.

A line's key is the line without the ASCII white space at its ends, A-Z in
lower case. A key of at least ``min_chars`` code points that two documents or
more hold loses all its lines, except in the document with the smallest id that
holds it; there they all stay. Other lines stay, joined by line feeds.

1. Every text is cut once; a row of 64-bit key hashes (each once a document),
   the number of lines and a digest of the whole text is written.
2. From these hashes two Bloom filters are made, of keys seen once and of keys
   seen twice. A task sends its own filters as bit positions, dealt by parts of
   the filter; the owner of a part adds them one by one: a bit that is set in
   the once-filter already is set in the twice-filter. Nothing a document holds
   leaves its task but these positions. The size follows the number of keys
   (``BITS`` a key) up to ``MAX_BITS`` (64 MB), the bound of what is broadcast.
   A larger corpus makes a fuller filter: more keys are suspected and confirmed
   below, nothing is lost.
3. With the twice-filter in hand texts are read again. Only a document that has
   a suspected key goes on, with its text and the 128-bit hashes of these keys.
4. Exact confirmation: an aggregate with a map-side step gives the smallest and
   the largest document of each suspected key; keys of one document are dropped.
   The documents after the smallest one get their lists of keys from a join of
   two written tables, in which Spark can split a key that very many share.
5. These documents are cut again and their lines are taken out.

Defined results: a null text is an empty one, which is one empty line; rows that
share an id are one document (none repeats the other's lines) and each keeps
its own text; rows without an id are one document that comes after all others;
a repeated row gets its result as often as it comes; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import KEY, SPACES, doc_key, ship, written

ship(__name__)

MIN_CHARS = 10
#: Filter bits a key. A key seen once passes the twice-filter by chance if other
#: keys hit both of its bits: at two probes a key one in 70, or fewer.
BITS, MAX_BITS, PART_BITS = 16, 1 << 29, 1 << 20
#: Keys that a task adds up before it sends their bit positions.
FLUSH = 1_000_000
DOC = ["_none", "_d"]                      # the document: id is null, id
STRIP = SPACES.encode()


def cut(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys; ``b""`` for a key that is too short."""
    lines = (text or b"").split(b"\n")
    keys = [x.strip(STRIP).lower() for x in lines]
    return lines, [k if len(k) >= 4 * min_chars or len(k) >= min_chars and len(k.decode("utf-8", "replace")) >= min_chars else b""
                   for k in keys]


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.schema.names.index("text")).cast(pa.binary()).to_pylist()


def _with(batch: pa.RecordBatch, rows: list[int], drop: set[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """These rows of a batch without the columns ``drop``, and new columns."""
    some = batch if len(rows) == batch.num_rows else batch.take(pa.array(rows, pa.int64()))
    have = {n: some.column(i) for i, n in enumerate(some.schema.names) if n not in drop}
    return pa.RecordBatch.from_pydict(have | new)


def rows_of(docs: DataFrame) -> DataFrame:
    """Row key, document and text of each row."""
    return docs.select(*doc_key(F.col("doc_id"), F.col("text")), F.col("doc_id").isNull().alias("_none"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text")


def line_table(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per row: key columns, ``n_lines``, the digest of the whole text
    and ``hashes``, the document's keys as 64-bit hashes in one binary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, hashes = [], [], []
            for text in _texts(batch):
                lines, keys = cut(text, min_chars)
                n.append(len(lines))
                sha.append(hashlib.sha256(text or b"").hexdigest())
                hashes.append(b"".join(digest(k)[:8] for k in set(keys) if k))
            yield _with(batch, range(batch.num_rows), {"text"}, {
                "n_lines": pa.array(n, pa.int64()), "text_sha256": pa.array(sha), "hashes": pa.array(hashes, pa.binary())})

    schema = rows.drop("text").schema.simpleString()[len("struct<"):-1]
    return rows.mapInArrow(run, f"{schema},n_lines:bigint,text_sha256:string,hashes:binary")


def probes(h: np.ndarray, bits: int) -> np.ndarray:
    """The two filter positions of each hash, from different halves of it."""
    low = np.uint64(bits - 1)
    return np.concatenate([h & low, (h >> np.uint64(32)) & low])


def filter_bits(n_keys: int, bits_per_key: int = BITS, most: int = MAX_BITS) -> int:
    return min(max(PART_BITS, 1 << (bits_per_key * max(n_keys, 1) - 1).bit_length()), most)


def _positions(bits: int):
    """A task's two filters, as positions by part: ``part, once, twice``."""
    def send(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, count = np.unique(np.frombuffer(b"".join(blobs), "<u8"), return_counts=True)
        once, twice = (np.unique(probes(x, bits)) for x in (h, h[count > 1]))
        parts = np.unique(once // PART_BITS).astype("i8")
        edges = np.append(parts, parts[-1:] + 1) * PART_BITS if len(parts) else parts
        pack = lambda x, lo: (x[np.searchsorted(x, lo):np.searchsorted(x, lo + PART_BITS)] - np.uint64(lo)).astype("<u4").tobytes()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(parts, pa.int32()), "once": pa.array([pack(once, int(lo)) for lo in edges[:-1]], pa.binary()),
            "twice": pa.array([pack(twice, int(lo)) for lo in edges[:-1]], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, have = [], 0
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                blobs.append(blob)
                have += len(blob) // 8
                if have >= FLUSH:
                    yield from send(blobs)
                    blobs, have = [], 0
        if have:
            yield from send(blobs)
    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The twice-filter of each part, from rows sorted by part."""
    part, once, twice = None, None, None
    done = lambda: pa.RecordBatch.from_pydict({
        "part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})
    for batch in batches:
        for p, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if p != part:
                if part is not None:
                    yield done()
                part, once, twice = p, np.zeros(PART_BITS, bool), np.zeros(PART_BITS, bool)
            seen = np.frombuffer(a, "<u4")
            twice[seen[once[seen]]] = True
            twice[np.frombuffer(b, "<u4")] = True
            once[seen] = True
    if part is not None:
        yield done()


def twice_filter(lines: DataFrame, bits_per_key: int = BITS, most: int = MAX_BITS) -> np.ndarray:
    """The Bloom filter (bytes, at most ``most`` bits) of hashes that came
    twice; only its parts reach the driver."""
    n = lines.agg(F.sum(F.octet_length("hashes") / 8)).first()[0] or 0
    bits = filter_bits(int(n), bits_per_key, most)
    sent = lines.select("hashes").mapInArrow(_positions(bits), "part int, once binary, twice binary")
    parts = (sent.repartition(bits // PART_BITS, "part").sortWithinPartitions("part")
             .mapInArrow(_merged, "part int, bits binary"))
    out = np.zeros(bits // 8, "u1")
    for row in parts.collect():                       # bits / 8 bytes in all, 64 MB at most
        at = row.part * PART_BITS // 8
        out[at:at + PART_BITS // 8] = np.frombuffer(row.bits, "u1")
    return out


def suspected(rows: DataFrame, twice: np.ndarray, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows that hold a key which passes the filter: key columns, text, and
    ``keys``, the 128-bit hashes of those keys."""
    sent = rows.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        bits = len(held) * 8
        for batch in batches:
            digests, counts = [], []
            for text in _texts(batch):
                new = [digest(k) for k in set(cut(text, min_chars)[1]) if k]
                digests += new
                counts.append(len(new))
            at = probes(np.frombuffer(b"".join(digests), "<u8")[::2], bits).reshape(2, -1)
            passed = ((held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("u1")) & 1).all(axis=0)
            ends = np.cumsum([0, *counts])
            found = [[digests[j] for j in ends[i] + np.flatnonzero(passed[ends[i]:ends[i + 1]])] for i in range(len(counts))]
            some = [i for i, x in enumerate(found) if x]
            yield _with(batch, some, set(), {"keys": pa.array([found[i] for i in some], pa.list_(pa.binary()))})

    schema = rows.schema.simpleString()[len("struct<"):-1]
    return rows.mapInArrow(run, f"{schema},keys:array<binary>")


def repeated(suspects: DataFrame) -> DataFrame:
    """``key`` and its first document ``first`` for keys of two documents or more."""
    doc = F.struct(*DOC)
    ends = suspects.select(F.explode("keys").alias("key"), *DOC).groupBy("key").agg(
        F.min(doc).alias("first"), F.max(doc).alias("last"))
    return ends.filter(F.col("first") != F.col("last")).select("key", "first")


def changed(docs: DataFrame, lines: DataFrame | None = None, min_chars: int = MIN_CHARS, bits_per_key: int = BITS,
            most: int = MAX_BITS) -> DataFrame:
    """Rows that lose lines, by row key: ``n_dropped`` and ``text_left``."""
    rows = rows_of(docs)
    lines = lines if lines is not None else written(line_table(rows, min_chars), "op13-lines")
    some = written(suspected(rows, twice_filter(lines, bits_per_key, most), min_chars), "op13-suspected")
    repeats = written(repeated(some), "op13-repeated")
    held = some.select(F.explode("keys").alias("key"), *DOC).join(repeats, "key")
    later = held.filter(F.struct(*DOC) > F.col("first")).groupBy(*DOC).agg(F.collect_set("key").alias("gone"))
    todo = some.select(*KEY, *DOC[:1], "text").dropDuplicates(KEY).join(later, DOC)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, left = [], []
            for text, gone in zip(_texts(batch), batch.column(batch.schema.names.index("gone")).to_pylist()):
                gone = set(gone)
                cuts = zip(*cut(text, min_chars))
                kept = [x for x, k in cuts if not k or digest(k) not in gone]
                n.append((text or b"").count(b"\n") + 1 - len(kept))
                left.append(b"\n".join(kept))
            yield pa.RecordBatch.from_pydict({c: batch.column(batch.schema.names.index(c)) for c in KEY} | {
                "n_dropped": pa.array(n, pa.int64()), "text_left": pa.array(left, pa.binary()).cast(pa.string())})

    return todo.select(*KEY, "text", "gone").mapInArrow(run, "_d long, _t long, n_dropped long, text_left string")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: what is left of each row's lines."""
    lines = written(line_table(rows_of(docs)), "op13-lines")
    out = changed(docs, lines).select(*KEY, "n_dropped", F.sha2("text_left", 256).alias("left_sha256"))
    return lines.join(out, KEY, "left").select(
        "doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("left_sha256", "text_sha256").alias("kept_sha256"))
