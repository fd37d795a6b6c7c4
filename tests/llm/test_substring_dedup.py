"""Operator 8 against a brute-force version on small tables."""

import random

import numpy as np
import pytest

from pitchside.llm import substring_dedup as sub


def brute(rows, window):
    """rows: (doc_id, text); a window goes if its words start earlier."""
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    least, out = {}, []
    for doc, w in split:
        for p in range(len(w) - window + 1):
            if doc is not None:
                s = tuple(w[p:p + window])
                least[s] = min(least.get(s, doc), doc)
    for doc, w in split:
        gone, seen = set(), set()
        for p in range(len(w) - window + 1):
            s = tuple(w[p:p + window])
            if s in seen or s in least and (doc is None or least[s] < doc):
                gone |= set(range(p, p + window))
            seen.add(s)
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("seed,words", [(1, "a b"), (2, "a b c d e f"), (3, "x y z ü q\x85r 1 2 3 4 5 6 7")])
def test_random_texts(spark, seed, words):
    rnd = random.Random(seed)
    v = words.split(" ")
    passage = [" ".join(rnd.choice(v) for _ in range(rnd.randint(4, 30))) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [rnd.choice(passage) if rnd.random() < 0.4 else " ".join(rnd.choice(v) for _ in range(rnd.randint(0, 25)))
                 for _ in range(rnd.randint(0, 4))]
        rows.append((i * 3 % 60, rnd.choice([" ", "\n", "\t  "]).join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(20)] + [(None, rows[0][1]), (None, rows[0][1]), (None, None), (5, rows[9][1]),
             (200, None), (201, ""), (202, "a " * 5000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    base = sub.base_rows(docs)
    got = base.join(sub.changed(docs, base, 6, 3), sub.KEY, "left").collect()
    by = {}
    for (doc, n, gone, kept), (_, text) in zip(brute(rows, 6), rows):
        by.setdefault((doc, n), []).append((gone, kept))
    assert len(got) == len(rows)
    for r in got:
        assert any(g == (r.n_removed or 0) and (r.n_removed is None or k == r.kept) for g, k in by[r.doc_id, r.n_words]), r
        assert sum(s.length for s in r.spans or []) == (r.n_removed or 0)
        assert r.kept is None or r.kept.encode() == b" ".join(r.text_left.encode().split())


def test_rolling_equals_direct():
    w = np.random.default_rng(0).integers(0, 2 ** 63, 300).astype("u8")
    for n in (1, 2, 3, 5, 8, 13, 20):
        want = []
        for i in range(len(w) - n + 1):
            h = 0
            for x in w[i:i + n].tolist():
                h = (h * sub.BASE_1 + x) % 2 ** 64
            want.append(h)
        assert sub.rolling(w, n, sub.BASE_1).tolist() == want
    for n in (6, 20):
        place, grams = sub.minimizer_places(w, n, 3)
        rank = [((g ^ g >> 32) * sub.MIX % 2 ** 64) >> 24 for g in grams.tolist()]
        assert place.tolist() == [min(range(i, i + n - 2), key=lambda j: (rank[j], j)) for i in range(len(w) - n + 1)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sub.digests(docs).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in sub.digests(one).collect()] == [(1, 2, 0)]
