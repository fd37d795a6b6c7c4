"""Operator 5 against a brute-force version on small tables."""

import random
import re

import pytest

from pitchside.llm import decontaminate as dec

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for p in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[p:p + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for win, ids in wins.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p:p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    named |= {str(i) for i in ids if i is not None}
        out.append((doc, len(w), len(hit), sorted(named)))
    return out


@pytest.mark.parametrize("block_bytes", [dec.BLOCK_BYTES, 2000])
def test_random_texts(spark, block_bytes):
    rnd = random.Random(3)
    vocabulary = ["ab", "cd", "É", "x1", "Zoo", "the", "ñu"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 4, 6, 9]))) for i in range(12)] + [(3, text(7)), (None, text(3)), (50, None), (51, "--"), (52, "")]
    items += [(60, items[0][1]), (0, items[0][1])]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(40)] + [(1, "other text"), (None, text(50)), (None, None), (7, None), (8, "")]
    docs += docs[:3] + [(99, text(3000))]
    got = dec.decontaminate(
        spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string"),
        spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, w int"), 6, 3, block_bytes).collect()
    want = brute(docs, items, 6)
    key = str
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=key) == sorted(want, key=key)
    assert all(r.n_hit == sum(s.length for s in r.spans) for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dec.decontaminate(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in dec.decontaminate(docs, items.limit(0)).collect()] == [0]
    assert [(r.n_hit, r["items"]) for r in dec.decontaminate(docs, items).collect()] == [(2, ["1"])]


def test_clean_keeps_rows_whole(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"x {passage} y", "a"), (1, "other", "b"), (None, passage, "c"), (None, None, "d"), (3, "", "e")],
                                 "doc_id long, text string, row string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert sorted(r["row"] for r in dec.clean(docs, items).collect()) == ["b", "d", "e"]
