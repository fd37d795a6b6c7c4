"""Operator 12 against a brute-force version: every stretch at every lag."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pitchside.llm import periodic_runs as pr


def brute_runs(w, least=24, exponent=3):
    """Maximal stretches of equal words q apart, those of the smallest period."""
    n, out, seen = len(w), [], set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            # a smaller period of the same stretch has been met before
            if length >= max(least, exponent * q) and (i, length) not in seen:
                out.append((i, length, q))
                seen.add((i, length))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)), n)


def random_words(rnd):
    alphabet = [f"w{i}" for i in range(rnd.choice([1, 2, 3, 8, 60]))]
    out = []
    for _ in range(rnd.randint(0, 6)):
        unit = [rnd.choice(alphabet) for _ in range(rnd.choice([1, 2, 3, 5, 9, 17, 30]))]
        if rnd.random() < 0.3:                         # a run inside the period
            unit = unit + [unit[0]] * rnd.randint(20, 40)
        k = rnd.choice([1, 1, 2, 3, 4, 9])
        out += (unit * k)[:len(unit) * k - rnd.randint(0, len(unit) - 1)]
        out += [rnd.choice(alphabet + ["rare%d" % rnd.randint(0, 99)]) for _ in range(rnd.choice([0, 0, 1, 5]))]
    return out


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("least", [1, 5, 24])
def test_runs_of_random_words(seed, least):
    rnd = random.Random(seed)
    docs = [random_words(rnd) for _ in range(40)]
    ids = {x: i for i, x in enumerate({y for d in docs for y in d})}
    w = np.array([ids[x] for d in docs for x in d], "i8")
    starts = np.cumsum([0, *map(len, docs)])
    got = pr.runs_of(w, starts, least)
    want = [(s + starts[k], length, q) for k, d in enumerate(docs) for s, length, q in brute_runs(d, least)]
    assert [tuple(r) for r in got.tolist()] == want
    a, b = pr.segments(w, starts, least)
    if len(a):                                         # no run crosses a cut
        for s, length, _ in want:
            assert ((a <= s) & (s + length <= b)).any()


def test_query_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([" ", "\n", " \t"]).join(random_words(rnd))) for i in range(300)]
    prose = [" ".join(rnd.choice(["the", "of", "and"] + [f"x{j}" for j in range(90)]) for _ in range(rnd.randint(0, 400))) for _ in range(60)]
    rows += [(1000 + i, t) for i, t in enumerate(prose)]
    rows += [(None, rows[3][1]), (None, None), (5, rows[9][1]), (5, rows[9][1]), (7, None), (8, ""), (9, " \n\t "), (30, "a b c " * 30),
             (31, "é " * 24), (32, "é " * 23), (-3, "x y z " * 50), (2 ** 62, "1 2 " * 12)]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, runs int, collapsed string").repartition(4)
    got = sorted((tuple(r) for r in pr.digests(docs).collect()), key=repr)
    assert got == sorted((brute(*r) for r in rows), key=repr)
    assert any(r[1] > 1 for r in got) and pr.digests(docs).columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"]


def test_very_long_texts(spark):
    rnd = random.Random(1)
    unit = [f"u{rnd.randint(0, 5000)}" for _ in range(70_000)]
    letters = [rnd.choice("abc") for _ in range(200_000)]            # no word is rare, few runs
    texts = [" ".join((unit * 4)[:250_000]), " ".join(letters), "same " * 300_000]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    rows = {r.n_words: r for r in pr.collapse(docs).collect()}
    assert [tuple(r) for r in rows[250_000].runs] == [(0, 250_000, 70_000)] and rows[250_000].collapsed == " ".join(unit)
    assert [tuple(r) for r in rows[300_000].runs] == [(0, 300_000, 1)] and rows[300_000].collapsed == "same"
    assert len(rows) == 3


def test_rounds_are_bounded():
    # each round sets free one more word: without a bound as many rounds as words
    n = 30_000
    w = np.repeat(np.arange(n // 3), 3) + np.tile([0, 0, 1], n // 3)
    a, b = pr.segments(w.astype("i8"), np.array([0, n]))
    assert (b - a >= pr.MIN_LENGTH).all()


def test_empty_table(spark):
    assert pr.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        pr.collapse(spark.createDataFrame([], "doc_id long, text string"), exponent=2)
