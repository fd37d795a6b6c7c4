"""Operator 11 against a brute-force trie, with base blocks of several sizes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from pitchside.llm import conversation_trie as ct

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def token(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)


def sequences(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), *token(role, text)))
    return {c: [x[2] for x in sorted(v)] for c, v in own.items()}


def rebuilt(rows):
    own, out = sequences(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below[node] = (sum(below[k][0] for k in kids[node]) or 1,
                       (len(members[node]) - 1) * words + sum(below[k][1] for k in kids[node]))
    out = []
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids[node]), *below[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    said = ["hi", "yes please", "no", "tell me more\nabout it", "", None, "ä ö", "\x0b"]
    rows = []
    scripts = [[(rnd.choice(["user", "assistant", None, ""]), rnd.choice(said)) for _ in range(rnd.choice([1, 2, 5, 9, 20, 70]))]
               for _ in range(7)]
    for c in [*range(60), *range(1000, 1030), -7, -20, 2 ** 40, 5000]:
        script = list(rnd.choice(scripts))
        if rnd.random() < 0.6:
            script[rnd.randrange(len(script)):] = [("user", rnd.choice(said)) for _ in range(rnd.randint(0, 3))]
        turns = list(range(len(script)))
        if rnd.random() < 0.3:
            turns = [rnd.choice([None, 0, 3, 300, 10_000, -5]) for _ in script]       # ties and nulls
        rows += [(c, t, *x) for t, x in zip(turns, script)]
    rows += [rows[0], rows[0], (None, 1, "user", "of nobody"), (77, 0, "user", "long " * 50_000)]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "conv_id long, turn int, role string, text string, name string, depth int").repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = ct.nodes(frame(spark, rows)).select(COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rebuilt(rows))


@pytest.mark.parametrize("block", [1, 2, 64])
def test_block_sizes_agree(spark, block, monkeypatch):
    monkeypatch.setattr(ct, "PIECE_BITS", 2)
    rows = corpus(3)
    slices = ct.numbered(frame(spark, rows))
    got = ct.trie(*ct.own(slices), block).select(COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(sequences(rows))


def test_a_long_conversation_and_its_copy(spark):
    rows = [(c, t, "user", f"turn {t} of many") for c in (40, 44) for t in range(3000)] + [(44, 3000, "user", "one more")]
    slices = ct.numbered(frame(spark, rows))
    got = sorted((r.depth, r.n_convs, r.n_leaves, r.saved_tokens) for r in ct.trie(*ct.own(slices)).collect())
    assert got == [(d, 2 if d <= 3000 else 1, 1, (3000 - max(d, 1) + 1) * 4 if d <= 3000 else 0) for d in range(3002)]


def test_turnless_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert ct.nodes(spark.createDataFrame([], schema)).count() == 0
    short = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(short, 0, "user", "a b c")]
    got = [tuple(r) for r in ct.nodes(spark.createDataFrame(rows, schema)).select(COLUMNS).collect()]
    assert got == brute(rebuilt(rows)) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]
