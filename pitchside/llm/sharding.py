"""Operator 10: a reproducible shuffle into shards by a Feistel permutation.

Rows get global numbers 0 .. N-1 in the order of a digest of id and text. The
number is permuted over exactly 0 .. N-1; the permuted number modulo the shard
count is the shard, its quotient the slot. So shard sizes differ by one at most
(the law is ``rows``), slots have no gaps, and place and number can be computed
from one another without the data (``position`` and its inverse ``row_number``).

Numbers: the first hex digits of the digest deal rows into ``SLICES`` slices
that do not depend on the data's layout; counts per slice (one small row each)
give the offsets, and a window numbers the rows inside a slice.

Permutation: a number is a pair (x, y) of residues modulo ``a`` and ``b``, with
``a * b`` barely over N. Rounds add a hash of one half to the other, in turn,
which can be undone. A result of N or more is permuted again (cycle walking);
there are fewer than ``a`` such numbers, so this is rare, and it ends, since a
cycle that starts below N comes back below N.

Defined results: a null text has no bytes (size 16, checksum 0), a null id is
digested as such; repeated rows get numbers of their own; an empty table gives
an empty result; columns beyond id and text are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.llm.common import written

SHARDS, SLICES, ROUNDS, WALKS, SEED = 40, 4096, 8, 64, 42


def _halves(n: int) -> tuple[int, int]:
    """``a``, ``b`` with ``a * b >= n`` and ``a * b - n < a``."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _round(own: Column, other: Column, i: Column, modulus: int, seed: int, sign: int) -> Column:
    return F.pmod(own + sign * F.pmod(F.xxhash64(other, i, F.lit(seed)), F.lit(modulus)), F.lit(modulus))


def _feistel(v: Column, n: int, seed: int, back: bool) -> Column:
    a, b = _halves(n)

    def step(s: Column, i: Column) -> Column:
        i = ROUNDS - 1 - i if back else i
        sign = -1 if back else 1
        return F.when(i % 2 == 0, F.struct(_round(s["x"], s["y"], i, a, seed, sign).alias("x"), s["y"].alias("y"))) \
            .otherwise(F.struct(s["x"].alias("x"), _round(s["y"], s["x"], i, b, seed, sign).alias("y")))

    start = F.struct(F.floor(v / b).cast("long").alias("x"), F.pmod(v, F.lit(b)).cast("long").alias("y"))
    exact = F.struct(((v - F.pmod(v, F.lit(b))) / b).cast("long").alias("x"), start["y"].alias("y")) if n > 2 ** 50 else start
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), exact, step, lambda s: s["x"] * b + s["y"])


def _walk(v: Column, n: int, seed: int, back: bool) -> Column:
    """Permute until the result is below ``n``."""
    a, b = _halves(n)
    beyond = min(a * b - n, WALKS)
    if beyond <= 0:
        return v
    end = F.aggregate(F.sequence(F.lit(1), F.lit(beyond)), v,
                      lambda acc, _: F.when(acc < n, acc).otherwise(_feistel(acc, n, seed, back)))
    return F.when(v < n, v).otherwise(end)


def permute(df: DataFrame, number: str, out: str, n: int, seed: int = SEED, back: bool = False) -> DataFrame:
    """``df`` with ``out``: the (inverse) permutation of ``number`` over 0 .. n-1."""
    first = df.withColumn(out, _feistel(F.col(number).cast("long"), n, seed, back))
    done = first.withColumn(out, _walk(F.col(out), n, seed, back))
    missed = F.raise_error(F.lit("cycle walking did not end")).cast("long")
    return done.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(missed))


def position(df: DataFrame, number: str, n: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` of the global row number."""
    x = permute(df, number, "_place", n, seed)
    return x.withColumns({"shard": F.pmod("_place", F.lit(shards)).cast("int"),
                          "slot": ((F.col("_place") - F.pmod("_place", F.lit(shards))) / shards).cast("long")}).drop("_place")


def row_number(df: DataFrame, n: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The inverse: ``df`` with the global ``row_number`` of ``shard`` and ``slot``."""
    x = df.withColumn("_place", F.col("slot") * shards + F.col("shard"))
    return permute(x, "_place", "row_number", n, seed, back=True).drop("_place")


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, size, text_crc32, row_number`` and the number of rows."""
    raw = F.col("text").cast("binary")
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"),
                            F.coalesce(F.col("text"), F.lit(""))).cast("binary"))
    rows = written(docs.select(
        "doc_id", (F.coalesce(F.octet_length(raw), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"), digest.alias("digest"),
        F.col("text").isNull().alias("no_text")), "op10-rows")
    width = len(f"{SLICES - 1:x}")
    rows = rows.withColumn("slice", F.conv(F.substring("digest", 1, width), 16, 10).cast("int"))
    counts = rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))            # at most SLICES rows
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.select("slice", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "op10-slices")
    n = counts.agg(F.sum("n")).first()[0] or 0
    inside = F.row_number().over(Window.partitionBy("slice").orderBy("digest", "doc_id", "no_text"))
    out = rows.withColumn("_inside", inside).join(F.broadcast(counts.select("slice", "before")), "slice")
    return out.select("doc_id", "size", "text_crc32", (F.col("before") + F.col("_inside") - 1).alias("row_number")), n


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document row: ``doc_id``, ``size``, ``text_crc32``,
    ``row_number``, ``shard`` and ``slot``."""
    rows, n = numbered(docs)
    return position(rows, "row_number", max(n, 1), shards, seed)


def shards(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                               F.lit(None).cast("int").alias("grown_shard"), "row_number")
