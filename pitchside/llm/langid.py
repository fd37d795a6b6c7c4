"""Operator 6: language identification by nearest centroid.

A text is lower-cased; everything that is not a letter is a gap; its letter
trigrams (gaps included) are hashed into ``DIM`` buckets. Its vector is
``log(1 + count) * idf``, normalised to length one. Every language has up to
``clusters`` centroids. The prediction is the language of the centroid with
the greatest cosine, which is the score.

Fitting, on the rows with a label that are not held out:

1. document frequencies of all buckets over all training rows (one pass);
2. clusters: spherical k-means on a sample of at most ``SAMPLE`` distinct texts
   with a letter a language, the least by hash (the only place where a sample
   is used), on the driver; a language with such a text is always in it;
3. centroids anew from all training rows, each given to the nearest cluster of
   its language, and a histogram of these rows' cosines per language (one pass).

Rejection is by distance, by bands of text length (powers of two of the number
of different trigrams: a word repeated is a short text), since a cosine grows
with length, that of junk too. From 32 trigrams on a text is rejected if its
cosine is below a share (three quarters from 256 trigrams on, a half below) of the
0.1 % quantile of the cosines of training rows of its language and band. A band
with fewer than ``ENOUGH`` rows takes those of the bands next to it; where the
language has too few, all languages count (the lower floor holds). Shorter texts,
and all texts where these are too few as well, are rejected only if they have
nothing in common with any language (cosine 0), so single words stay, however few
rows were learned from; texts without letters are rejected and ``und``. Junk that is
as near to a language as the texts it learned from (hex strings on sf0.1) stays.

The model is ``DIM`` floats a centroid, whatever the corpus; it is bounded by
the number of distinct labels and broadcast. Text is the only input of a
prediction.

Defined results: null text or no letter: ``und``, score 0, rejected; with no
training row at all every text is ``und``; a null id counts as an empty text
for the held-out rule; rows with a null label or text do not train; equal rows
get equal results; an empty table gives an empty result; other columns pass
through untouched in ``predict`` unless they have the name of a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchside.llm.common import free_name, ship, task_state, written

ship(__name__)

DIM, CLUSTERS, SAMPLE, ROUNDS = 4096, 3, 400, 8
QUANTILE, BINS = 0.001, 1000
#: Share of the quantile that is the floor: of middle and of long texts; the floor of short ones.
MIDDLE, SLACK, NOTHING = 0.5, 0.75, 1e-9
#: Bands of length; the first of middle and of long texts; rows that a band needs.
BANDS, SHORT, LONG, ENOUGH = DIM.bit_length(), 5, 8, 200
#: Parts of a language's draws that are cut to the least ones before they meet.
PARTS = 16
UND = "und"


@dataclass
class Model:
    langs: list[str]            # language of each centroid
    centroids: np.ndarray       # one row a centroid, length one
    idf: np.ndarray
    floors: np.ndarray          # least cosine that is not rejected, per centroid and band

    def broadcast(self, spark: SparkSession):
        """As plain values: a worker needs no class of this package for them."""
        return spark.sparkContext.broadcast((self.langs, self.centroids, self.idf, self.floors))


def _letters() -> np.ndarray:
    table = task_state()
    if "letters" not in table:
        table["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return table["letters"]


def counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of letter trigrams; None where there is no letter."""
    cp = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[cp]
    if not letter.any():
        return None
    cp = np.where(letter, cp, 32).astype("u8")
    # a trigram has its letter in the middle: runs of gaps say nothing
    h = cp[:-2] * np.uint64(0x9E3779B1) + cp[1:-1] * np.uint64(0x85EBCA77) + cp[2:] * np.uint64(0xC2B2AE3D)
    h = h[letter[1:-1]]
    h = (h ^ (h >> np.uint64(15))) * np.uint64(0x2C1B3C6D)
    return np.bincount(((h >> np.uint64(12)) % np.uint64(DIM)).astype("i8"), minlength=DIM)


def weighed(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c.astype("f4")) * idf
    return v / np.linalg.norm(v)


def vector(text: str | None, idf: np.ndarray) -> np.ndarray | None:
    c = counts(text)
    return None if c is None else weighed(c, idf)


def band(c: np.ndarray) -> int:
    return int(np.count_nonzero(c)).bit_length() - 1


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _frequencies(sample: int):
    """Document frequencies (bucket -1: rows with a letter), and per language
    the least ``sample`` draws of the task's distinct texts with a letter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, draws = np.zeros(DIM, "i8"), 0, {}
        for batch in batches:
            for x, lang, draw in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                c = counts(x.as_py())
                if c is not None:
                    total += c > 0
                    rows += 1
                    own = draws.setdefault(lang, set())
                    own.add(draw)
                    if len(own) > 2 * sample:
                        draws[lang] = set(sorted(own)[:sample])
        at = np.flatnonzero(total)
        least = [(lang, x) for lang, own in draws.items() for x in sorted(own)[:sample]]
        n, none = len(at) + 1, len(least)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*at.tolist(), -1] + [None] * none, pa.int64()), pa.array([*total[at].tolist(), rows] + [None] * none, pa.int64()),
             pa.array([None] * n + [lang for lang, _ in least], pa.string()), pa.array([None] * n + [x for _, x in least], pa.int64())],
            names=["bucket", "n", "lang", "draw"])
    return run


def _sampled(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, at, value = [], [], []
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = vector(x.as_py(), idf)
                if v is not None:
                    k = np.flatnonzero(v)
                    langs.append(lang), at.append(k.astype("i4").tobytes()), value.append(v[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.binary()), pa.array(value, pa.binary())],
                                             names=["lang", "at", "value"])
    return run


def clusters_of(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; seeds by farthest point from the mean's nearest."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c


def _sums(model, order: list[str]):
    """Per centroid the sum of its rows' vectors, per language and band a
    histogram of cosines: rows (kind, which, place, value)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, centroids, idf, _ = model.value
        of = {lang: np.flatnonzero(np.array(langs) == lang) for lang in order}
        total, seen = np.zeros(centroids.shape, "f8"), np.zeros((len(order), BANDS * (BINS + 1)), "i8")
        for batch in batches:
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                n = counts(x.as_py())
                if n is not None:
                    v = weighed(n, idf)
                    if lang not in of:
                        raise ValueError(f"the sample has no text of the language {lang!r}")
                    cos = centroids[of[lang]] @ v
                    total[of[lang][cos.argmax()]] += v
                    seen[order.index(lang), band(n) * (BINS + 1) + int(min(max(cos.max(), 0), 1) * BINS)] += 1
        a, b = np.nonzero(total)
        c, d = np.nonzero(seen)
        kind = np.repeat([0, 1], [len(a), len(c)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind), pa.array(np.append(a, c)), pa.array(np.append(b, d)),
             pa.array(np.append(total[a, b], seen[c, d]).astype("f8"))], names=["kind", "which", "place", "value"])
    return run


def floors(seen: np.ndarray) -> np.ndarray:
    """Per language and band, from the histograms of cosines."""
    def quantile(rows: np.ndarray) -> float:
        return (np.cumsum(rows) / rows.sum() < QUANTILE).sum() / BINS

    def near(rows: np.ndarray, b: int) -> np.ndarray:
        """The band's rows, with those of the bands next to it until they are enough."""
        for k in range(BANDS):
            total = rows[max(b - k, SHORT):b + k + 1].sum(axis=0)
            if total.sum() >= ENOUGH:
                break
        return total

    out, pooled = np.zeros(seen.shape[:2]), seen.sum(axis=0)
    for i, own in enumerate(seen):
        for b in range(BANDS):
            mine, all_ = near(own, b), near(pooled, b)
            slack = SLACK if b >= LONG else MIDDLE
            if b >= SHORT and mine.sum() >= ENOUGH:
                out[i, b] = slack * quantile(mine)
            elif b >= SHORT and all_.sum() >= ENOUGH:
                out[i, b] = slack * min(quantile(x) for x in (mine, all_) if x.any())
            else:
                out[i, b] = NOTHING
    return out


def fit(docs: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """Learn from ``text`` and ``lang`` of the rows that are not held out."""
    spark = docs.sparkSession
    train = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.xxhash64("text", F.lit(11)).alias("draw")
    found = written(train.select("text", "lang", draw).mapInArrow(_frequencies(sample), "bucket long, n long, lang string, draw long"),
                    "op6-found")
    df = found.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = {r.bucket: r.n for r in df.collect()}                           # DIM numbers and the number of rows
    rows = df.pop(-1, 0)
    idf = np.ones(DIM, "f4")
    for b, n in df.items():
        idf[b] = np.log((1 + rows) / (1 + n)) + 1
    if not rows:
        return Model([], np.zeros((0, DIM), "f4"), idf, np.zeros((0, BANDS)))
    # of each language the texts with the least hashes, copies once: as many as it has, up to the bound
    least = found.filter("draw is not null").select("lang", "draw").distinct()
    for keys in (["lang", F.pmod("draw", F.lit(PARTS))], ["lang"]):      # a language's draws meet in parts first
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("draw"))
        least = least.withColumn("_rank", rank).filter(F.col("_rank") <= sample).select("lang", "draw")
    picked = (train.select("text", "lang", draw).join(F.broadcast(least), ["lang", "draw"])
              .groupBy("lang", "draw").agg(F.min("text").alias("text"))
              .select("lang", "text").mapInArrow(_sampled(idf), "lang string, at binary, value binary"))
    groups: dict[str, list[np.ndarray]] = {}
    for r in sorted(picked.collect()):
        v = np.zeros(DIM, "f4")
        v[np.frombuffer(r.at, "i4")] = np.frombuffer(r.value, "f4")
        groups.setdefault(r.lang, []).append(v)
    order = sorted(groups)
    found = {lang: clusters_of(np.stack(groups[lang]), clusters) for lang in order}
    langs = [lang for lang in order for _ in found[lang]]
    model = Model(langs, np.concatenate([found[lang] for lang in order]).astype("f4"), idf, np.zeros((len(langs), BANDS)))
    sums = (train.select("lang", "text").mapInArrow(_sums(model.broadcast(spark), order),
                                                    "kind long, which long, place long, value double")
            .groupBy("kind", "which", "place").agg(F.sum("value").alias("value")))
    total, seen = np.zeros(model.centroids.shape, "f8"), np.zeros((len(order), BANDS * (BINS + 1)))
    for r in sums.collect():                     # at most DIM numbers a centroid and a histogram a language
        (total if r.kind == 0 else seen)[r.which, r.place] = r.value
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    model.centroids = np.where(norm > 0, total / np.where(norm > 0, norm, 1), model.centroids).astype("f4")
    floor = floors(seen.reshape(len(order), BANDS, BINS + 1))
    model.floors = np.array([floor[order.index(lang)] for lang in langs])
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``."""
    shared = model.broadcast(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, centroids, idf, least = shared.value
        for texts in batches:
            lang, score, out = [], [], []
            for x in texts:
                c = counts(x.as_py()) if langs else None
                if c is None:
                    lang.append(UND), score.append(0.0), out.append(True)
                    continue
                cos = centroids @ weighed(c, idf)
                best = int(cos.argmax())
                lang.append(langs[best]), score.append(float(min(max(cos[best], 0), 1))), out.append(bool(cos[best] < least[best, band(c)]))
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())],
                                             names=["lang_pred", "score", "rejected"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    said = F.arrow_udf(run, "lang_pred string, score double, rejected boolean")(F.col(text))
    at = free_name(docs, "_said")
    out = docs.withColumn(at, said)
    return out.withColumns({c: F.col(f"{at}.{c}") for c in ("lang_pred", "score", "rejected")}).drop(at)


def predictions(docs: DataFrame) -> DataFrame:
    """Fit on the table's training rows, predict every row."""
    slim = docs.select("doc_id", "text", "lang")
    out = predict(slim.select("doc_id", "text"), fit(slim))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
