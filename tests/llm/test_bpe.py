"""Operator 3 against tiktoken and against exact round trips."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from pitchside.llm import bpe
from pitchside.llm.queries import REGISTRY

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def lib():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(bpe.read_ranks(RANKS), P.PATTERN)


TEXTS = ["", "a", " ", "Hello, world's 123  end \n\n x", "naïve café ñandú 東京 🙂🙂‍", "<|endoftext|> text",
         "a" * 5000, "ab" * 3000 + "!", "é" * 4001, "\t\r\n " * 500, "aaab" * 999, "😀" * 800, "x\x00y\x1f\x85z w",
         "A՘b\U000323b0 \U00012550²", "0123456789" * 200]


@pytest.mark.parametrize("text", TEXTS)
def test_matches_the_library(lib, own, text):
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_random_long_pretokens(lib, own):
    rng = np.random.default_rng(7)
    for alphabet in ("ab", "theinrs", "abcdefghijklmnopqrstuvwxyz"):
        text = "".join(rng.choice(list(alphabet), 20_000))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode_ordinary(text)


def test_every_code_point_splits_alike(lib, own):
    for first in range(0, 0x110000, 64):
        text = "".join(f"a{chr(c)}a1{chr(c)}1 {chr(c)}!" for c in range(first, first + 64) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode_ordinary(text), hex(first)


def test_queue_orders_by_rank_then_position():
    q = bpe.RankQueue(300_000)
    items = [(int(r), int(p)) for r, p in zip(*np.random.default_rng(1).integers(0, [[300_000], [900]], (2, 4000)))]
    for r, p in items:
        q.push(r, p)
    got = []
    while q.top:
        got.append(q.pop())
    assert got == sorted(items)


def test_unknown_id_is_an_error(own):
    with pytest.raises(ValueError):
        own.decode(np.array([10 ** 9], "<u4").tobytes())


def test_nulls_repeats_clashes_and_empty(spark, lib):
    codec = bpe.ByteBPE(spark, RANKS, P.PATTERN)
    rows = [(1, None, "k"), (1, "", None), (None, "Hi there", "x"), (None, "Hi there", "x"), (4, "long " * 20_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = codec.decode(codec.encode(docs, ids="ids_"), ids="ids_", out="text_").collect()
    assert len(got) == 5
    for r in got:
        assert bytes(r.text_) == (r.text or "").encode()
        assert np.frombuffer(bytes(r.ids_), "<u4").tolist() == lib.encode_ordinary(r.text or "")
    assert codec.encode(docs.limit(0)).count() == 0
    named = docs.withColumn("_PAIR", docs.text)
    assert all(r["_PAIR"] == r.text for r in codec.round_trip(named, ids="a", out="b").collect())
    both = codec.round_trip(docs, ids="a", out="b").collect()
    assert sorted((bytes(r.a), bytes(r.b)) for r in both) == sorted((bytes(r.ids_), bytes(r.text_)) for r in got)


def test_query(spark, sf_dir, lib):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = REGISTRY["op3_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = lib.encode_ordinary(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
