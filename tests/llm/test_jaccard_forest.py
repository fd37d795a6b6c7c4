"""Operator 7 against a brute-force version on small tables."""

import random

import numpy as np
import pytest

from pitchside.llm import jaccard_forest as jf


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w)} - {()} if len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, threshold):
    texts = sorted({tuple((t or "").encode().lower().split()) for _, t in rows} - {()})
    sets = [shingles(b" ".join(t).decode(), n) for t in texts]
    links, root = [0] * len(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    place = {t: k for k, t in enumerate(texts)}
    own = [tuple((t or "").encode().lower().split()) for _, t in rows]
    out = []
    for (doc, _), w in zip(rows, own):
        if not w:
            out.append((doc, doc, 1, 0))
            continue
        ids = [d for (d, _), x in zip(rows, own) if x and root[place[x]] == root[place[w]] and d is not None]
        out.append((doc, min(ids, default=None), own.count(w), links[place[w]]))
    return out


@pytest.mark.parametrize("block_rows", [1024, 5])
def test_random_texts(spark, block_rows):
    rnd = random.Random(5)
    v = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):
        base = [rnd.choice(v) for _ in range(rnd.choice([3, 5, 8, 60, 120]))]
        for _ in range(rnd.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = rnd.choice(v)
            rows.append((len(rows) * 7 % 1000, " ".join(copy)))
    rows += [(2000, rows[3][1].upper()), (None, rows[3][1]), (None, rows[4][1]), (None, None), (1, None), (2, ""), (3, " \n")]
    rows += [(3000 + i, "one two") for i in range(9)] + [(3000, "one two"), (None, "unlike the rest of them all")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, size int, keys string")
    got = jf.link(docs, threshold=0.7, trees=30, depth=4, recall=0.9999, block_rows=block_rows)
    got = [(r.doc_id, r.class_id, r.n_copies, r.n_links) for r in got.collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows, 5, 0.7)))


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 200))).astype("u8") for _ in range(40)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = jf.intersections(sets, 32)
    np.fill_diagonal(got, [len(s) for s in sets])
    assert got.tolist() == want


@pytest.mark.parametrize("pairs", [1, 8, 9, 300])
def test_overlaps_of_the_pairs_asked_for(pairs):
    rng = np.random.default_rng(pairs)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype("u8") for _ in range(40)]
    asked = np.zeros((40, 40), bool)
    asked[tuple(rng.choice(40, (2, pairs)))] = True
    asked = (asked | asked.T) & ~np.eye(40, dtype=bool)
    got = jf.overlaps(sets, asked)
    assert all(got[x, y] == len(np.intersect1d(sets[x], sets[y])) for x, y in zip(*np.nonzero(asked)))


@pytest.mark.parametrize("shared", [0, 1, 31, 32, 33, 64, 65])
def test_intersections_at_the_column_edges(shared):
    sets = [np.append(np.arange(shared), 1000 + own).astype("u8") for own in (0, 1)]
    assert jf.intersections(sets, 32)[0, 1] == shared


@pytest.mark.parametrize("shared", [1, 4096, 4097])
def test_intersections_at_the_default_columns(shared):
    assert jf.intersections([np.arange(shared, dtype="u8")] * 2).tolist() == [[shared] * 2] * 2


def test_one_shared_shingle(spark):
    rows = [(i, " ".join([w] * k)) for i, (w, k) in enumerate([("spam", 5), ("spam", 6), ("spam", 9), ("egg", 7), ("egg", 8), ("ham", 5)])]
    got = jf.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows, 5, 0.8)))
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {0: (0, 2), 1: (0, 2), 2: (0, 2), 3: (3, 1), 4: (3, 1), 5: (5, 0)}


def test_prefix_is_shortened_to_the_recall():
    assert jf.prefix_length(0.8, 12, 6, 0.999) == 3 and jf.prefix_length(0.8, 16, 6, 0.999) == 4
    assert jf.prefix_length(0.8, 12, 6, 0.1) == 6
    assert jf.prefix_length(0.8, 2, 6, 0.9999) == 1


def test_empty_table(spark):
    assert jf.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_measured_recall():
    assert jf.measured_recall(0, 0, 0.8, 16, 6) == pytest.approx(jf.shares_node(0.8, 16, 6))       # no evidence, no early end
    assert jf.measured_recall(0, 0, 0.8, 16, 4) >= 0.999
    assert jf.measured_recall(9999, 1, 0.8, 16, 5) >= 0.999 > jf.measured_recall(9999, 30, 0.8, 16, 5)


def planted(pairs, changed, seed):
    """Pairs of 94 words, of which the last ``changed`` differ: Jaccard (90 - c) / (90 + c)."""
    rnd = random.Random(seed)
    for _ in range(pairs):
        w = [f"{rnd.getrandbits(40):x}" for _ in range(94 + changed)]
        yield " ".join(w[:94]), " ".join(w[:94 - changed] + w[94:])


def test_recall_by_band(spark):
    """Production parameters on planted pairs; 0.8 exactly, 0.818, 0.856, 0.915, 0.978 and, below the threshold, 0.782."""
    pairs = [(c, p) for c in (10, 9, 7, 4, 1, 11) for p in planted(300, c, c)]
    docs = spark.createDataFrame([(2 * i + side, text) for i, (_, p) in enumerate(pairs) for side, text in enumerate(p)],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in jf.classes(docs).collect()}
    found = {}
    for i, (c, _) in enumerate(pairs):
        a, b = got[2 * i], got[2 * i + 1]
        assert (a.n_links, b.n_links, b.class_id) in ((1, 1, 2 * i), (0, 0, 2 * i + 1))
        found[c] = found.get(c, 0) + a.n_links
    assert found[11] == 0 and all(found[c] >= 297 for c in (10, 9, 7, 4, 1))


def test_prefixes_are_shortened_until_the_recall_is_met(spark, monkeypatch):
    depths, climb = [], jf.climb
    monkeypatch.setattr(jf, "climb", lambda found, texts, d, *rest: depths.append(d) or climb(found, texts, d, *rest))
    weak = spark.createDataFrame([(2 * i + s, t) for i, p in enumerate(planted(5, 10, 1)) for s, t in enumerate(p)], "doc_id long, text string")
    jf.link(weak, recall=0.9).count()
    assert depths == [6]                          # whole labels are enough for 0.9
    depths.clear()
    jf.link(weak, recall=0.999).count()
    assert depths == [6, 5, 4]


def test_long_text_and_blocks_by_shingles(spark):
    rnd = random.Random(11)
    long = [f"w{rnd.getrandbits(30)}" for _ in range(60_000)]
    other = long[:30_000] + ["x"] * 40 + long[30_040:]
    short = [f"v{i}" for i in range(100)]
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(short)), (4, " ".join(short[:-1])), (5, " ".join(short[:-2]))]
    got = jf.link(spark.createDataFrame(rows, "doc_id long, text string"), block_shingles=60).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {1: (1, 1), 2: (1, 1), 3: (3, 2), 4: (3, 2), 5: (3, 2)}


def test_components_of_a_chain_of_rising_names(spark, monkeypatch):
    rounds, written = [], jf.written
    monkeypatch.setattr(jf, "written", lambda df, label: (label == "op7-to" and rounds.append(1)) or written(df, label))
    edges = spark.createDataFrame([(i, 0, i + 1, 0) for i in range(60)] + [(100, 0, 101, 0)], "ra long, rb long, to_a long, to_b long")
    got = {r.ra: r.to_a for r in jf.components(edges).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[0] <= 60 and got[100] == got[101] and got[100] >= 100
    assert len(rounds) <= 12
