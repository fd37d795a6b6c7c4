"""Operator 8: repeated token windows, by Rabin-Karp hashes.

Words are runs of anything but ASCII white space, unchanged. A window is
``window`` consecutive words of one document. A word is removed if a window
over it has a word sequence that also starts earlier: in a document with a
smaller id, or earlier in the same document. Windows are judged on the input.

Every window gets a Rabin-Karp hash (two rolling polynomials over 64-bit word
hashes, modulo 2^64 and odd bases). Counting all of them would shuffle a row
per word, so windows that cannot repeat are set aside first, without loss:

1. Copies. Of documents with equal words (and a window at all) those that do
   not have the smallest id lose all words; this needs one hash a document.
2. Filter. Each window has a minimizer: its ``gram``-word hash of least rank,
   leftmost on ties. Equal windows have equal minimizers at different places,
   so a window whose minimizer occurs once in the corpus does not repeat. One
   entry per minimizer (about one in seven words) goes, packed in arrays, to
   the task that owns its hash range. A minimizer met twice in the same batch
   is sent once, whatever its count, so a passage that a third of all documents
   share stays small; its documents are known on the spot.
3. Windows over repeated minimizers are counted in Spark by their hashes: the
   smallest document id per hash, then the places in later documents. The join
   of the two reads a written table, so Spark can split a hot hash.
4. Repeated windows of a document merge into maximal spans.

Defined results: a null or empty text has no words and keeps none; texts with
fewer words than a window stay whole; a null id comes after all numbers, and
rows that share an id (or lack one) are not earlier than one another: each row
is a document, judged against smaller ids and against itself. An empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import KEY, doc_key, salted_left_join, ship, written
from pitchside.llm.hashing import BASE_1, BASE_2, rolling, word_hashes

ship(__name__)

WINDOW, GRAM = 20, 8
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Words that are hashed together in a task.
CHUNK_WORDS = 500_000
#: Words of the corpus per hash range (about 600,000 entries of 17 bytes).
RANGE_WORDS = 4_000_000
MIX = 0xBF58476D1CE4E5B9


def minimizer_places(w: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place of its minimizer; and the ``gram`` hashes."""
    grams = rolling(w, gram, BASE_1)
    with np.errstate(over="ignore"):
        rank = (grams ^ (grams >> np.uint64(32))) * np.uint64(MIX)
    place = np.arange(len(grams), dtype="u8")
    low = np.uint64((1 << 24) - 1)
    key = (rank & ~low) | (place & low)         # least rank, then leftmost
    span, size, best = window - gram + 1, 1, key
    while size * 2 <= span:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    m = len(w) - window + 1
    best = np.minimum(best[:m], best[span - size:span - size + m])
    start = np.arange(m, dtype="u8")
    return (start + (((best & low) - start) & low)).astype("i8"), grams


def _chunks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple]:
    """Documents of a task in chunks: rows with at least a window, word hashes
    one after another, and the start of each row's words."""
    rows, parts, have = [], [], 0
    for batch in batches:
        table = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        texts = table.pop("text").cast(pa.binary())
        others = {c: v.to_pylist() for c, v in table.items()}
        for i in range(len(texts)):
            w = word_hashes(texts[i].as_py())
            if len(w) < window:
                continue
            rows.append({c: v[i] for c, v in others.items()})
            parts.append(w)
            have += len(w)
            if have >= CHUNK_WORDS:
                yield rows, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
                rows, parts, have = [], [], 0
    if rows:
        yield rows, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def _window_rows(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and row of every window that lies inside one document."""
    counts = np.diff(starts) - window + 1
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(starts[:-1] - np.cumsum(np.concatenate([[0], counts[:-1]])), counts)
    return first + np.arange(len(row)), row


def _packed_minimizers(window: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, (rows, w, starts) in enumerate(_chunks(batches, window)):
            at, row = _window_rows(starts, window)
            place, grams = minimizer_places(w, window, gram)
            place = place[at]
            new = np.ones(len(at), bool)
            new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
            m = grams[place[new]]
            k = np.array([r["k"] for r in rows], "i8")[row[new]]
            order = np.argsort(m, kind="stable")
            m, k = m[order], k[order]
            edge = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
            count = np.diff(np.append(edge, len(m)))
            again = np.repeat(count > 1, count)
            # met twice here: its documents need no answer; the hash is sent once
            yield _batch([int(xxhash.xxh64_intdigest(k[:64].tobytes()) % buckets)], [True], [m[again]], [k[again]], [b""])
            m, k, twice = m[edge], k[edge], (count > 1).astype("u1")
            bucket = (m % np.uint64(buckets)).astype("i8")
            order = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[order], return_index=True)
            cut = [order[a:b] for a, b in zip(first, np.append(first[1:], len(order)))]
            yield _batch(used.tolist(), [False] * len(cut), [m[c] for c in cut], [k[c] for c in cut],
                         [twice[c].tobytes() for c in cut])
    return run


def _batch(bucket, known, m, k, twice) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int64()), pa.array(known, pa.bool_()), pa.array([x.tobytes() for x in m], pa.binary()),
         pa.array([x.tobytes() for x in k], pa.binary()), pa.array(twice, pa.binary())],
        names=["bucket", "known", "m", "k", "twice"])


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range: the documents' minimizers that occur twice or more."""
    known, asked = pdf[pdf["known"]], pdf[~pdf["known"]]
    unpack = lambda column, kind: np.frombuffer(b"".join(column), kind)
    m, k, twice = unpack(asked["m"], "i8"), unpack(asked["k"], "i8"), unpack(asked["twice"], "u1")
    order = np.argsort(m, kind="stable")
    m, k, twice = m[order], k[order], twice[order]
    edge = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])) if len(m) else np.empty(0, int)
    count = np.diff(np.append(edge, len(m)))
    more = np.repeat((count > 1) | (np.maximum.reduceat(twice, edge) > 0 if len(m) else np.empty(0, bool)), count)
    more &= twice == 0
    return pd.DataFrame({"k": np.concatenate([k[more], unpack(known["k"], "i8")]),
                         "m": np.concatenate([m[more], unpack(known["m"], "i8")])})


def _windows(window: int, gram: int):
    """Hashes of the windows over repeated minimizers, the first of equal ones
    in a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, w, starts in _chunks(batches, window):
            at, row = _window_rows(starts, window)
            place, grams = minimizer_places(w, window, gram)
            m = grams[place[at]].view("i8")
            keep = np.zeros(len(at), bool)
            for i, (a, b) in enumerate(zip(starts[:-1] - window * np.arange(len(rows)) + np.arange(len(rows)),
                                           starts[1:] - window * np.arange(1, len(rows) + 1) + np.arange(1, len(rows) + 1))):
                keep[a:b] = np.isin(m[a:b], np.array(rows[i]["ms"], "i8"))
            at, row = at[keep], row[keep]
            h1 = rolling(w, window, BASE_1)[at].view("i8")
            h2 = (rolling(w, window, BASE_2)[at] >> np.uint64(32)).astype("u4").view("i4")
            order = np.lexsort((at, h2, h1, row))
            first = np.ones(len(order), bool)
            first[1:] = ((row[order[1:]] != row[order[:-1]]) | (h1[order[1:]] != h1[order[:-1]])
                         | (h2[order[1:]] != h2[order[:-1]]))
            at, row, h1, h2 = (x[np.sort(order[first])] for x in (at, row, h1, h2))
            ids = [np.array([r[c] for r in rows], "i8")[row] for c in KEY]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h2), *map(pa.array, ids), pa.array((at - starts[row]).astype("i4"))],
                names=["h1", "h2", *KEY, "pos"])
    return run


def spans_of(w: np.ndarray, later: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed spans of a document (first words, ends): windows that
    occur in earlier documents (``later``: their starts) or earlier in it."""
    gone = np.zeros(max(0, len(w) - window + 1), bool)
    gone[later] = True
    if len(gone):
        h = np.stack([rolling(w, window, BASE_1), rolling(w, window, BASE_2)])
        order = np.lexsort((np.arange(len(gone)), h[1], h[0]))
        same = (h[:, order[1:]] == h[:, order[:-1]]).all(axis=0)
        gone[order[1:][same]] = True
    edge = np.zeros(len(w) + 1, "i8")
    at = np.flatnonzero(gone)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    covered = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype("i1"), [0]])
    step = np.diff(covered)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def without(text: bytes, firsts: np.ndarray, ends: np.ndarray) -> bytes:
    """The kept words joined by one space."""
    words = text.split()
    kept, last = [], 0
    for a, b in zip(firsts, ends):
        kept += words[last:a]
        last = b
    return b" ".join(kept + words[last:])


def text_without(text: bytes, firsts: np.ndarray, ends: np.ndarray) -> bytes:
    """The text less the removed words and the white space after each."""
    start = [m.start() for m in WORD.finditer(text)] + [len(text)]
    parts, last = [], 0
    for a, b in zip(firsts, ends):
        parts.append(text[last:start[a]])
        last = start[b]
    return b"".join([*parts, text[last:]])


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            texts, out = col["text"].cast(pa.binary()), []
            for i in range(len(texts)):
                text = texts[i].as_py()
                a, b = spans_of(word_hashes(text), np.array(col["later"][i].as_py() or [], "i8"), window)
                if len(a):
                    out.append((col["_d"][i].as_py(), col["_t"][i].as_py(), int((b - a).sum()),
                                without(text, a, b).decode(), text_without(text, a, b).decode(),
                                [{"first": int(x), "length": int(y - x)} for x, y in zip(a, b)]))
            d, t, n, kept, left, spans = map(list, zip(*out)) if out else ([], [], [], [], [], [])
            span = pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.string()),
                 pa.array(left, pa.string()), pa.array(spans, span)], names=["_d", "_t", "n_removed", "kept", "text_left", "spans"])
    return run


CHANGED = "_d long, _t long, n_removed long, kept string, text_left string, spans array<struct<first:long,length:long>>"


def words_joined(text: Column) -> Column:
    """The words of a text joined by one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def base_rows(docs: DataFrame) -> DataFrame:
    """Per row: key, id, number of words and digest of its words; written once."""
    joined = words_joined(F.col("text"))
    words = F.when(F.col("_w") == "", 0).otherwise(F.char_length("_w") - F.char_length(F.replace("_w", F.lit(" "))) + 1)
    return written(docs.select(*doc_key(F.col("doc_id"), F.col("text")), "doc_id", joined.alias("_w"))
                   .select(*KEY, "doc_id", words.cast("long").alias("n_words"), F.sha2("_w", 256).alias("words_sha256")),
                   "op8-base")


def changed(docs: DataFrame, base: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """A row for each key that loses words: ``n_removed``, ``kept`` (the words
    that stay, joined by one space), ``text_left`` (the text less the removed words
    and the white space after them) and ``spans`` (first word and length)."""
    spark = docs.sparkSession
    # hash ranges: one per shuffle partition, and more where the corpus asks for
    # it, so that the entries of a range always fit into a task
    words = base.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // RANGE_WORDS))
    docs = docs.select(*doc_key(F.col("doc_id"), F.col("text")), "text")
    # 1. whole copies; a hot text is spread over tasks
    full = base.filter(F.col("n_words") >= window).select(*KEY, "n_words", "words_sha256")
    least = full.groupBy("words_sha256").agg(F.min("_d").alias("_first"), F.max("_d").alias("_last"))
    least = least.filter(F.col("_last") > F.col("_first")).select("words_sha256", "_first")
    copies = written(salted_left_join(full, least, ["words_sha256"], KEY)
                     .filter(F.col("_d") > F.col("_first")).select(*KEY, "n_words").distinct(), "op8-copies")
    # 2. documents with repeated minimizers
    key = F.xxhash64(*KEY).alias("k")
    packed = docs.select(key, "text").mapInArrow(
        _packed_minimizers(window, gram, buckets), "bucket long, known boolean, m binary, k binary, twice binary")
    repeated = packed.groupBy("bucket").applyInPandas(_repeated, "k long, m long")
    asked = repeated.groupBy("k").agg(F.collect_set("m").alias("ms"))
    left_out = copies.select(key).distinct()
    asked = asked.join(left_out, "k", "left_anti")
    found = written(docs.withColumn("k", key).join(asked, "k").select(*KEY, "text", "ms"), "op8-found")
    # 3. counts of the windows' hashes
    hashes = found.mapInArrow(_windows(window, gram), "h1 long, h2 int, _d long, _t long, pos int")
    firsts = hashes.groupBy("h1", "h2").agg(F.min("_d").alias("_first"), F.max("_d").alias("_last"))
    firsts = written(firsts.filter(F.col("_last") > F.col("_first")).select("h1", "h2", "_first"), "op8-firsts")
    later = hashes.join(firsts, ["h1", "h2"]).filter(F.col("_d") > F.col("_first"))
    later = written(later.groupBy(*KEY).agg(F.collect_set("pos").alias("later")), "op8-later")
    # 4. spans
    cut = found.join(later, KEY, "left").select(*KEY, "text", "later").mapInArrow(_cut(window), CHANGED).dropDuplicates(KEY)
    gone = copies.select(*KEY, F.col("n_words").alias("n_removed"), F.lit("").alias("kept"), F.lit("").alias("text_left"),
                         F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("length"))).alias("spans"))
    return cut.unionByName(gone)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns, derived from the operator's."""
    base = base_rows(docs)
    out = base.join(changed(docs, base).select(*KEY, "n_removed", F.sha2("kept", 256).alias("_sha")), KEY, "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce("_sha", "words_sha256").alias("kept_sha256"))
