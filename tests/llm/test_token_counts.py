"""Operator 1: totals against recounting, idempotent commits, compaction."""

from collections import Counter

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from pitchside.llm import token_counts as tc
from pitchside.llm.bpe import read_ranks
from pitchside.llm.common import fresh_path
from pitchside.llm.queries import REGISTRY

ROW = "_d long, _t long, source string, lang string, tokenizer string, n_tokens long"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_query_against_recounting(spark, sf_dir):
    lib = {v: tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path(f"{v}.tiktoken")), special_tokens={})
           for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    least, docs, n = {}, spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), Counter()
    for r in docs:
        least[r.text] = min(least.get(r.text, r.doc_id), r.doc_id)
    tokens = Counter()
    for r in docs:
        if least[r.text] == r.doc_id:
            v = "byte_bpe_50k" if r.lang == "en" else "byte_bpe_multi_50k"
            n[r.source, r.lang, v] += 1
            tokens[r.source, r.lang, v] += len(lib[v].encode_ordinary(r.text or ""))
    got = REGISTRY["op1_token_counts"](spark, sf_dir).collect()
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in got} == {k: (n[k], tokens[k]) for k in n}


def test_commits_are_idempotent_and_signed(spark):
    rollup = tc.Rollup(spark, fresh_path(spark, "t"))
    assert totals(rollup) == {}
    a = spark.createDataFrame([(1, 1, "s", "en", "v1", 10), (2, 2, "s", None, "v1", 5), (2, 2, "s", None, "v1", 5), (3, 3, None, "en", "v1", 0)], ROW)
    assert rollup.commit("b1", tc.signed(None, a)) and not rollup.commit("b1", tc.signed(None, a))
    assert totals(rollup) == {("s", "en", "v1"): (1, 10), ("s", None, "v1"): (2, 10), (None, "en", "v1"): (1, 0)}
    b = spark.createDataFrame([(1, 1, "s", "en", "v2", 8), (2, 2, "s", None, "v1", 5)], ROW)
    change = tc.signed(a, b)
    assert sorted(r.sign for r in change.collect()) == [-1, -1, -1, 1]       # the row both have is not written
    assert rollup.commit("b2", change)
    want = {("s", "en", "v2"): (1, 8), ("s", None, "v1"): (1, 5)}
    assert totals(rollup) == want
    assert rollup.compact() and totals(rollup) == want
    assert not rollup.commit("b2", change) and totals(rollup) == want          # folded, and still committed
    assert rollup.commit("b3", tc.signed(b, None)) and totals(rollup) == {}
    assert rollup.commit("b4", change.limit(0)) and not rollup.commit("b4", change) and totals(rollup) == {}


def test_unfinished_batch_is_not_read(spark):
    root = fresh_path(spark, "t")
    rollup = tc.Rollup(spark, root)
    a = spark.createDataFrame([(1, 1, "s", "en", "v1", 10)], ROW)
    tc.signed(None, a).groupBy(*tc.GROUP).agg(F.count("sign").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")) \
        .write.parquet(f"{root}/batches/b1-crashed")
    assert totals(rollup) == {}
    assert rollup.commit("b1", tc.signed(None, a)) and totals(rollup) == {("s", "en", "v1"): (1, 10)}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1), (1, None, None, None, 1), (None, "", "s", "en", 1), (5, "a" * 300_000, "s", "en", 2),
                                  (6, "a" * 300_000, "s", "de", 2)], "doc_id long, text string, source string, lang string, n_tokens int")
    paths = [(v, P.path(f"{v}.tiktoken")) for v in ("byte_bpe_50k", "byte_bpe_multi_50k")]
    got = totals(tc.maintain(docs, fresh_path(spark, "t"), *paths, ["de"], P.PATTERN))
    assert got[None, None, "byte_bpe_50k"] == (2, 0) and got["s", "en", "byte_bpe_50k"][0] == 2
    assert ("s", "de", "byte_bpe_multi_50k") not in got                        # a copy of document 5
    assert totals(tc.maintain(docs.limit(0), fresh_path(spark, "t"), *paths, ["de"], P.PATTERN)) == {}
