"""Operator 2: rules, order, gaps, wrapping and edge cases."""

import textwrap

from pitchside.llm import license_scan as ls

S = ls.SENTENCES


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, k string")
    got = {r.doc_id: r for r in ls.scan(docs).collect()}
    assert len(got) == len(texts)
    return [got[i]["licences"] for i in range(len(texts))], got


def test_rules(spark):
    mit = " ".join([S["mit-grant"], S["mit-notice"], S["mit-as-is"]])
    wrapped = "\n".join(f" * {x}" for x in textwrap.wrap(mit, 60))
    bsd = [S[x] for x in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")]
    texts = [
        "Some prose without a stop\nReleased under the MIT License.\nMore.",
        mit, wrapped, mit.upper(),
        " ".join([S["mit-notice"], S["mit-grant"], S["mit-as-is"]]),              # wrong order
        " ".join(bsd), " ".join(bsd[:3]), " ".join(bsd[:2]),                       # longest rule first; too short
        " ".join([S["gpl-free"], "One more.", "And two.", S["gpl3-terms"]]),       # a gap of two
        " ".join([S["gpl-free"], "One more.", "And two.", "And three.", S["gpl3-terms"]]),
        "Licensed under the Apache License, Version 2.0. All rights reserved.", "All rights reserved. " * 3000,
        None, "", " \n ", "!!!", "Released under the MIT License", "Not released under the MIT License at all.",
    ]
    got, rows = found(spark, texts)
    assert got == [["MIT"], ["MIT"], ["MIT"], ["MIT"], [], ["BSD-3-Clause"], ["BSD-2-Clause"], [], ["GPL-3.0-or-later"], [],
                   ["Apache-2.0", "proprietary"], ["proprietary"], [], [], [], [], ["MIT"], []]
    assert rows[11].n_known == 3000 and rows[11].n_matches == 3000


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ls.licences(docs).count() == 0


def test_every_rule_is_its_own_match(spark):
    texts = [" ".join(S[x] for x in sequence) for _, sequence in ls.RULES]
    got, _ = found(spark, texts)
    assert got == [[name] for name, _ in ls.RULES]


def test_rules_learnt_from_whole_texts(spark):
    a = "You may use it.\nYou may change it; you must say so.\nNo warranty."
    b = "You may use it. You may not change it."
    sentences, rules = ls.learn(spark.createDataFrame([("A", a), ("A", a), ("B", b), ("C", "!!!"), ("D", None), (None, a)], "licence string, text string"))
    texts = [a, b, "Preface. " + a.upper() + " Afterword.", a + " " + b, "No warranty. You may use it.", "You may use it.", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in ls.scan(docs, sentences, rules).collect()}
    assert [got[i] for i in range(7)] == [["A"], ["B"], ["A"], ["A", "B"], [], [], []]


def test_tables_decide(spark):
    """Overlaps, ties, sentences of one normal form, unknown names, thousands of rules."""
    text = lambda w: f"{w} one. {w} two. {w} three."
    sentences = [(f"{w}{i}", f"{w} {n}") for w in ("a", "b") for i, n in enumerate(("one", "two", "three"))] + [("same", "A, ONE!"), ("none", "...")]
    rules = [(5, "long", ["a0", "a1", "a2"]), (6, "short", ["same", "a1"]), (7, "late", ["a1", "a2"]), (9, "tie", ["b2"]), (8, "least", ["b2"]),
             (10, "unknown", ["b0", "nobody"]), (11, "empty", ["none"])]
    rules += [(100 + i, f"L{i}", [f"s{i}", f"s{i + 1}"]) for i in range(3000)]
    sentences += [(f"s{i}", f"sentence number {i}") for i in range(3001)]
    tables = (spark.createDataFrame(sentences, "sentence_id string, sentence string"),
              spark.createDataFrame([(r, n, p, s) for r, n, ss in rules for p, s in enumerate(ss)], "rule_id long, licence string, place int, sentence_id string"))
    texts = [text("a"), "a one. a two.", "a two. a three.", text("b"), "Sentence number 7. Sentence number 8. Sentence number 9.", "", None]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts + texts)], "doc_id long, text string, licences string, row string")
    out = ls.scan(docs, *tables)
    got = {r.doc_id: r for r in out.collect()}
    want = [["long"], ["short"], ["late"], ["least"], ["L7"], [], []]
    assert [got[i].licences for i in range(14)] == want + want and {r.row for r in got.values()} == {"y"}
    assert got[4].n_known == 3 and got[4].n_matches == 1
    none = ls.scan(docs, tables[0].limit(0), tables[1].limit(0)).collect()
    assert len(none) == 14 and not any(r.licences or r.n_known for r in none)
