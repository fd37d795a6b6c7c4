"""The pipeline against its stages' brute-force versions, and edge cases."""

import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from pitchside.llm.bpe import read_ranks
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_jaccard_forest import brute as brute_links
from tests.llm.test_substring_dedup import brute as brute_windows


def expected(rows, items):
    """rows: (doc_id, text) with distinct ids."""
    classes = brute_links(rows, 5, 0.8)
    rows = [r for r, c in zip(rows, classes) if c[1] == r[0]]
    out = []
    for (doc, text), (_, n, gone, kept) in zip(rows, brute_windows(rows, 20)):
        out.append((doc, text if not gone else None, kept))
    hits = brute_hits([(doc, text if text is not None else kept) for doc, text, kept in out], items, 10)
    return [(doc, text, kept) for (doc, text, kept), h in zip(out, hits) if not h[2]]


def test_run_against_brute_force(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = expected(rows, items)                              # no row of this table is rejected in stage 1
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert sorted(got) == [d for d, _, _ in want]
    assert len(want) < len(rows) and any(t is None for _, t, _ in want)
    for doc, text, kept in want:
        r = got[doc]
        decoded = lib.decode(np.frombuffer(bytes(r.ids), "<u4").tolist())
        assert r.exact and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert r.n_tokens * 4 == len(r.ids) and r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest()
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == lib.encode_ordinary(decoded)
        assert decoded == text if text is not None else decoded.encode().split() == kept.encode().split()


def test_edges_pass_through_every_stage(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(12))
    prose = [" ".join(f"{w}{i}{j}" for j in range(30) for w in ("the", "and")) for i in range(30)]
    rows = [(i, p, "en", "s", len(p), 1) for i, p in enumerate(prose)] + [(100, prose[0], "en", "s", 1, 2), (0, prose[0], "en", "s", 1, 3),
            (None, prose[1], None, None, None, 4), (None, "und " + prose[2][:150], None, None, None, 5), (None, None, "en", "s", 0, 6),
            (7, None, None, None, None, 7), (8, "", "en", "s", 0, 8), (9, "123", "en", "s", 3, 9), (200, f"and {item} the", "en", "s", 9, 10),
            (201, "the " * 30_000, "en", "s", 9, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, root long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "byte_bpe" or out.columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = docs.collect()
    ids = sorted(r.doc_id for r in got if r.doc_id is not None)
    assert ids == [*range(30), 201] and all(r.exact for r in got)
