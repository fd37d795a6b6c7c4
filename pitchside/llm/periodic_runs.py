"""Operator 12: periodic runs of words, by recursive frequency splitting.

A run is a stretch of consecutive words whose smallest period is ``q`` (words q
apart are identical), at least ``MIN_LENGTH`` words and ``EXPONENT`` periods
long, that no neighbouring word extends keeping the period. Words are runs of
anything but ASCII white space, unchanged, numbered from 0.

Documents are independent of one another, so Spark deals rows to tasks and
nothing is shuffled; a task takes its documents in chunks of words, as arrays.

1. Splitting. A word of a qualifying run comes at least EXPONENT times in it,
   hence in the segment that holds the run. Words that are rarer than that in
   their segment split it, pieces shorter than MIN_LENGTH go, and the pieces are
   counted again, all segments of a chunk in one sorted pass a round, until no
   segment changes. (A segment that loses less than 1/64 of its words is not
   counted once more: its pieces are scanned as they are, which changes no
   result and bounds the rounds.) Prose loses nearly all its words here.
2. Lag scan of what is left. For lags q of (g/2, g], g = 1, 2, 4, ..., every place
   gets the exact name of its g words (names of pairs of names of g/2), and is
   compared with the next place of the same name. In a run of period q that next
   place is exactly q words on, for all places up to q + g from its end: a
   smaller distance d would give the run the period gcd(d, q). So the stretches
   of consecutive places at one distance q are the runs of period q, maximal, and
   their smallest period is q. All lags together cost a sort per doubling, also
   in a text of a million words.
3. A word is dropped if a run contains it after the run's first period.

Defined results: a null or empty text has no words, no runs and an empty
collapsed text; rows are judged one by one, so ties of ids and repeated rows
have equal results; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import ship

ship(__name__)

MIN_LENGTH, EXPONENT = 24, 3
#: Words of the documents that are taken together.
CHUNK_WORDS = 400_000
#: A round that costs a segment less than one word in so many is its last.
SLOW = 64
Prepare = Callable[[int | None, list[bytes]], list[bytes]]
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def replayed(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting of some documents: from word a on, the words
    a to a + p - 1 again and again. A document without an id is left alone."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def _ranges(a: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the stretches that start at ``a``, and the stretch of each."""
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(a - (ends - size), size), np.repeat(np.arange(len(a)), size)


def segments(w: np.ndarray, starts: np.ndarray, least: int = MIN_LENGTH,
             often: int = EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """First and end places of the stretches that qualifying runs can lie in."""
    a, b, width = starts[:-1], starts[1:], int(w.max(initial=0)) + 1
    done = []
    while True:
        a, b = a[b - a >= least], b[b - a >= least]
        if not len(a):
            break
        at, seg = _ranges(a, b - a)
        _, same, count = np.unique(seg * width + w[at], return_inverse=True, return_counts=True)
        stays = count[same] >= often
        lost = np.bincount(seg[~stays], minlength=len(a))
        last = lost * SLOW < b - a
        inner = np.concatenate([[False], stays[:-1] & stays[1:] & (seg[1:] == seg[:-1])])   # goes on from the word before
        first = np.flatnonzero(stays & ~inner)
        end = np.flatnonzero(stays & ~np.append(inner[1:], False)) + 1
        stable = last[seg[first]]
        a, b = at[first], at[end - 1] + 1
        keep = stable & (b - a >= least)
        done.append((a[keep], b[keep]))
        a, b = a[~stable], b[~stable]
    if not done:
        return np.empty(0, "i8"), np.empty(0, "i8")
    return np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])


def lag_scan(w: np.ndarray, a: np.ndarray, b: np.ndarray, least: int = MIN_LENGTH,
             exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs inside the stretches."""
    if not len(a):
        return np.empty((0, 3), "i8")
    at, seg = _ranges(a, b - a)
    size = (b - a)[seg]
    end = np.cumsum(b - a)[seg]
    name = np.unique(seg * (int(w.max()) + 1) + w[at], return_inverse=True)[1].astype("i8")
    place, gram, found = np.arange(len(at)), 1, []
    while len(place):
        order = place[np.argsort(name[place], kind="stable")]
        lag = np.diff(order)
        near = (name[order[1:]] == name[order[:-1]]) & (lag > gram // 2) & (lag <= gram)
        i, q = order[:-1][near], lag[near]
        by = np.argsort(i)
        i, q = i[by], q[by]
        if len(i):
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(q) != 0)]))
            first, last, period = i[edge], i[np.append(edge[1:], len(i)) - 1], q[edge]
            length = last - first + gram + period
            ok = length >= np.maximum(least, exponent * period)
            found.append(np.stack([at[first[ok]], length[ok], period[ok]], axis=1))
        # names of twice as many words, where a run with a larger lag has room
        more = place[(place + 2 * gram <= end[place]) & (exponent * (gram + 1) <= size[place])]
        pair = name[more] * (len(at) + 1) + name[more + gram]
        name[more] = np.unique(pair, return_inverse=True)[1]
        place, gram = more, 2 * gram
    return np.concatenate(found) if found else np.empty((0, 3), "i8")


def runs_of(w: np.ndarray, starts: np.ndarray, least: int = MIN_LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """Runs of documents whose word numbers lie one after another, by start and period."""
    runs = lag_scan(w, *segments(w, starts, least, exponent), least, exponent)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _chunks(batches: Iterator[pa.RecordBatch], prepare: Prepare | None) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, words, have = [], [], 0
    for batch in batches:
        texts = batch.column(batch.schema.names.index("text")).cast(pa.binary())
        for doc_id, text in zip(batch.column(batch.schema.names.index("doc_id")).to_pylist(), texts):
            own = (text.as_py() or b"").split()
            ids.append(doc_id)
            words.append(prepare(doc_id, own) if prepare else own)
            have += len(own)
            if have >= CHUNK_WORDS:
                yield ids, words
                ids, words, have = [], [], 0
    if ids:
        yield ids, words


def _judged(prepare: Prepare | None, least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words in _chunks(batches, prepare):
            numbers: dict[bytes, int] = {}
            size = np.fromiter(map(len, words), "i8", len(words))
            w = np.fromiter((numbers.setdefault(x, len(numbers)) for doc in words for x in doc), "i8", int(size.sum()))
            starts = np.concatenate([[0], np.cumsum(size)])
            runs = runs_of(w, starts, least, exponent)
            doc = np.searchsorted(starts, runs[:, 0], side="right") - 1
            change = np.zeros(len(w) + 1, "i4")
            np.add.at(change, runs[:, 0] + runs[:, 2], 1)
            np.add.at(change, runs[:, 0] + runs[:, 1], -1)
            gone = np.cumsum(change) > 0
            for i in np.unique(doc):
                words[i] = [x for x, g in zip(words[i], gone[starts[i]:starts[i + 1]].tolist()) if not g]
            spans = pa.StructArray.from_arrays([pa.array(runs[:, 0] - starts[doc]), pa.array(runs[:, 1]), pa.array(runs[:, 2])],
                                               fields=list(RUN))
            edges = np.searchsorted(doc, np.arange(len(words) + 1))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(size),
                "runs": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), spans),
                "collapsed": pa.array([b" ".join(x) for x in words], pa.binary()).cast(pa.string())})
    return run


def collapse(docs: DataFrame, prepare: Prepare | None = None, least: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """One row per row: ``doc_id``, ``n_words``, ``runs`` (by start, then period)
    and ``collapsed``, the words outside repeated periods joined by one space.
    ``prepare`` may change a document's words first."""
    if exponent < 3:
        raise ValueError("the lag scan needs three periods or more")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _judged(prepare, least, exponent),
        "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the number of words."""
    found = collapse(docs, replayed)
    # the greatest length / period: cross products compare it exactly
    more = lambda r, b: r["length"] * b["period"] > b["length"] * r["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(more(r, b), r).otherwise(b))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    text = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    out = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                       F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"),
                      F.col("best.period").alias("period"),
                      F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256", "n_words")
