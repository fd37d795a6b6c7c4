"""Operator 9 against a brute-force version on small tables."""

import random
import re
from collections import Counter

from pitchside.llm import quality_lines as ql


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def normal(line):
    line = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    return " ".join(words(re.sub("[0-9]+", "0", line)))


def brute(rows, min_docs, share, keep):
    hosts = Counter(h for _, h in {(r[0], r[2]) for r in rows})
    seen = Counter((h, x) for _, h, x in {(doc, host, normal(x)) for doc, text, host in rows for x in (text or "").split("\n") if words(x)})
    out = []
    for doc, text, host in rows:
        w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
        win = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        rep = {i + j for i in range(len(w) - 7) if win[tuple(w[i:i + 8])] > 1 for j in range(8)}
        gone = [x for x in lines if seen[host, normal(x)] > max(min_docs, share * hosts[host])]
        n = sum(len(words(x)) for x in gone)
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        out.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
                    len(rep), n, len(gone), failed, not failed and len(w) - n >= keep * len(w)))
    return out


def test_random_texts(spark):
    rnd = random.Random(9)
    v = ["a", "B", "c#", "Éa", "12", "x|y", "7z", "q\x85q"]
    line = lambda: rnd.choice([" ", "  ", "\t"]).join(rnd.choice(v) for _ in range(rnd.randint(0, 9)))
    common = [line() + " tail 5", "Share THIS page 2024 now", "\x0b \r"]
    rows = []
    for i in range(80):
        parts = [rnd.choice(common) if rnd.random() < 0.3 else line() for _ in range(rnd.randint(0, 9))]
        rows.append((i, "\n".join(parts), rnd.choice(["h1", "h2", None])))
    rows += [(1, "\n".join(common * 4), "h1"), (None, None, "h1"), (None, "", None), (None, "x y", None), (3, "w " * 4000, "h2")] + rows[:4]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_words int")
    got = ql.judge(docs, 5, 0.1, 0.5).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                             "n_removed_words", "n_removed_lines", "base_failed", "kept").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute(rows, 5, 0.1, 0.5)))
    assert any(r.n_removed_lines for r in got) and any(r.kept for r in got)


def test_repeated_rows_are_one_document(spark):
    """A document that comes thirty times makes none of its lines frequent; the
    registered SQL says the same."""
    import duckdb

    from pitchside.llm.queries import ORACLES
    own = "\n".join(f"{a} {a} own line of this document number {a}" for a in "abcdefgh")
    rows = [(1, own, "h")] * 30 + [(10 + i, f"the other document {chr(97 + i % 26)}{chr(97 + i // 26)} " * 6 + "\nshared line", "h") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = ql.verdicts(docs)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(ORACLES["op9_quality_lines"])
    names = [d[0] for d in want.description]
    # the SQL takes the rows of an id together, also in what is counted inside a row
    across = [names.index(c) for c in ("doc_id", "n_removed_words", "n_removed_lines")]
    mine, sql = {tuple(r) for r in got.select(names).collect()}, set(want.fetchall())
    assert {r for r in mine if r[0] != 1} == {r for r in sql if r[0] != 1}
    assert {tuple(r[i] for i in across) for r in mine} == {tuple(r[i] for i in across) for r in sql}
    assert all(r.n_removed_words == 0 for r in got.collect() if r.doc_id == 1)


def test_very_long_text(spark):
    text = "\n".join(f"word{i % 997} " * 9 + f"end {i}" for i in range(40_000))
    docs = spark.createDataFrame([(1, text, "h"), (2, "one line", "h")], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_words for r in ql.verdicts(docs).collect()} == {1: 440_000, 2: 2}


def test_empty_table(spark):
    assert ql.verdicts(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
