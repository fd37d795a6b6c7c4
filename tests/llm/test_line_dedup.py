"""Operator 13 against a brute-force version on small tables."""

import hashlib
import random

import numpy as np
import pytest

from pitchside.llm import line_dedup as ld


def brute(rows, least=10):
    """rows: (doc_id, text); a line stays in the first document that has its key."""
    order = lambda d: (d is None, d or 0)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for doc, text in rows:
        for x in (text or "").split("\n"):
            first[key(x)] = min(first.get(key(x), order(doc)), order(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == order(doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    pool = ["  A common line of text\t", "a common LINE of text", "short", "nine char", "ten chars!", "ÄÖÜ ten ch", "Äten chars",
            "äten chars", "", "   ", "\x0bten chars!\x0c", "ten chars!", " ten chars!"] + [f"line number {i}" for i in range(40)]
    rows = [(i * 7 % 90, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(90)]
    rows += [(3, rows[5][1]), (4, rows[4][1]), (4, rows[4][1]), (None, rows[0][1]), (None, rows[0][1]), (None, "line of none of them"),
             (200, None), (201, ""), (202, "\n"), (203, "long " * 40_000 + "\nA COMMON line of text\n" + "only here, twice\n" * 2),
             (2 ** 63 - 1, "line number 1\nline of none of them")]
    return rows


@pytest.mark.parametrize("seed,bits", [(1, 8), (2, 8), (3, 0)])
def test_against_brute_force(spark, seed, bits, monkeypatch):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x", 1, "k") for r in rows],
                                 "doc_id long, text string, key string, n_lines int, first string").repartition(5)
    if not bits:                       # a filter that lets everything pass changes nothing
        monkeypatch.setattr(ld, "twice_filter", lambda *a: np.full(ld.PART_BITS // 8, 255, "u1"))
    got = ld.digests(docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    by = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got.collect()), key=by) == sorted(brute(rows), key=by)


def test_filters_miss_nothing_and_pass_little(spark, monkeypatch):
    monkeypatch.setattr(ld, "FLUSH", 500)
    rnd = np.random.default_rng(0)
    h = rnd.integers(0, 2 ** 63, 60_000).astype("<u8")
    again = np.concatenate([h, h[:5_000]])
    rnd.shuffle(again)
    lines = spark.createDataFrame([(bytearray(x.tobytes()),) for x in np.array_split(again, 300)], "hashes binary").repartition(7)
    held = ld.twice_filter(lines)
    assert len(held) * 8 == ld.filter_bits(65_000)
    at = ld.probes(h, len(held) * 8).reshape(2, -1).astype("i8")
    passed = ((held[at >> 3] >> (at & 7).astype("u1")) & 1).all(axis=0)
    assert passed[:5_000].all() and passed[5_000:].mean() < 0.03
    assert ld.filter_bits(0) == ld.PART_BITS and ld.filter_bits(10 ** 12) == ld.MAX_BITS


def test_empty_table_and_no_repeats(spark):
    assert ld.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = ld.digests(spark.createDataFrame([(1, "a single line"), (2, None)], "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:3] for r in got) == [(1, 1, 0), (2, 1, 0)]


def test_cut():
    assert ld.cut(None, 10) == ([b""], [b""])
    assert ld.cut("É2345678 X\r\n123456789\t\n".encode(), 10)[1] == ["É2345678 x".encode(), b"", b""]
