"""Operator 10 against the law, the round trip and direct checksums."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from pitchside.llm import sharding
from pitchside.llm.queries import REGISTRY


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 41, 997, 10_000])
def test_permutation_and_inverse(spark, n):
    x = spark.range(n).withColumnRenamed("id", "v")
    got = sharding.row_number(sharding.position(x, "v", n, 4), n, 4).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted((i % 4, i // 4) for i in range(n))
    assert all(r.row_number == r.v for r in got)
    if n >= 997:
        assert sum(r.slot * 4 + r.shard == r.v for r in got) < n // 50


def test_seed_changes_the_order(spark):
    x = spark.range(500).withColumnRenamed("id", "v")
    a, b = (sharding.permute(x, "v", "p", 500, s).select(F.collect_list("p")).first()[0] for s in (1, 2))
    assert a != b and sorted(a) == sorted(b) == list(range(500))


def check(got, rows, shards):
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want


def test_edges_and_layout(spark):
    rows = [(i, f"text {i}" * (i % 5)) for i in range(200)] + [(None, None), (None, ""), (1, None), (None, "é" * 30_000)] + [(7, "same")] * 60
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    got = sharding.assign(docs, 7).collect()
    check(got, rows, 7)
    other = sharding.assign(docs.orderBy(F.rand(3)).repartition(5), 7).collect()
    assert sorted(map(str, got)) == sorted(map(str, other))
    assert sharding.shards(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = REGISTRY["op10_sharding"](spark, sf_dir).collect()
    check(got, rows, 40)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def xx(*values):
    """Spark's xxhash64 of numbers: each value is hashed with the hash so far as seed."""
    h = 42
    for v, form in values:
        h = xxhash.xxh64_intdigest(struct.pack(form, v), h)
    return h - (h >> 63 << 64)


def brute_place(v, n, seed=42):
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        x, y = divmod(v, b)
        for i in range(8):
            if i % 2 == 0:
                x = (x + xx((y, "<q"), (i, "<i"), (seed, "<i"))) % a
            else:
                y = (y + xx((x, "<q"), (i, "<i"), (seed, "<i"))) % b
        v = x * b + y
        if v < n:
            return v


def test_places_by_a_second_computation(spark, sf_dir):
    """Numbers by sorting digests, places by rounds on plain integers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(97)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(5, None), (5, "")]
    digest = lambda d, t: hashlib.md5(f"{d}:{t or ''}".encode()).hexdigest()
    ordered = sorted(rows, key=lambda r: (digest(*r), r[0], r[1] is None))
    want = [(d, zlib.crc32((t or "").encode()), n, *divmod(brute_place(n, len(rows)), 40)) for n, (d, t) in enumerate(ordered)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text_crc32, r.row_number, r.slot, r.shard) for r in got) == sorted(want)
