"""Operator 5: benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (an item with
fewer words, but not none, is one window). A document is contaminated where
all words of a window stand in it in a row: exact containment.

* Windows are cut into shingles of ``shingle`` words (a shorter window is one
  shingle). Shingles are ordered by rarity, that is by their count over all
  documents. To contain a window a document must contain each of its shingles,
  so the prefix of that order that has to be joined is its first element: the
  rarest shingle, with its place inside the window. Windows with a shingle that
  no document has are dropped here.
* One pass over the documents finds the places of all item shingles, with the
  words around them; their counts give the order. Only places of prefix
  shingles are joined on with the windows. The place of the shingle inside the
  window gives the place of the whole window in the document (positional
  bound), which must not leave the document (length bound).
* What is left is verified word by word over the item-sized window.

In that pass documents are exploded and probed inside one code-generated
stage: only places that have an item shingle leave it, and one row with the
number of words per document. The item shingles (hashes) are broadcast in
blocks of at most ``BLOCK_BYTES``, measured on the written table; a larger
benchmark makes more passes, with equal results. Windows shared by many items
are joined once and carry the key of their set of items.

Defined results: a null text has no words and is never contaminated; an
empty benchmark, or one without words, hits nothing; repeated item rows count
once, rows that share an item id count as texts of one item, and a row without
an item id counts its words as hit but names no item; document rows
that share an id but not a text are judged apart, equal rows each get the same
result; columns beyond id and text are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.llm.common import KEY, doc_key, with_words, written

WINDOW, SHINGLE = 10, 5
BLOCK_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between the words of the contract, after A-Z are lower case.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def lowered(text: Column) -> Column:
    """Lower-cases A-Z only; ``lower`` would change other letters as well, so
    it serves where the text is ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _hash(words: str, at: Column, size: int) -> Column:
    """Hash of the ``size`` words from 0-based place ``at``; of nulls past the end."""
    return F.xxhash64(F.lit(size), *[F.get(F.col(words), at + i) for i in range(size)])


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """One row per distinct window: ``win`` (its words), ``wid``, ``n`` and
    ``items`` (the sorted ids of the items that have it)."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), lowered(F.col("text")).alias("text"))
    w = with_words(w, F.col("text"), SEPARATORS).select("item_id", "w")
    w = w.filter(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window)))
    w = w.select("item_id", "n", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("at"), "w")
    w = w.select("item_id", F.slice("w", F.col("at") + 1, F.col("n")).alias("win"))
    return w.groupBy("win").agg(F.array_sort(F.collect_set("item_id")).alias("items")).select(
        "win", F.xxhash64("win").alias("wid"), F.size("win").alias("n"), "items")


def _blocks(frame: DataFrame, key: str, limit: int) -> list[DataFrame]:
    """A frame of hashes in parts of at most about ``limit`` bytes, by hash of ``key``."""
    parts = max(1, -(-frame.count() * 64 // limit))
    return [frame.filter(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(parts)) == i) if parts > 1 else frame
            for i in range(parts)]


def places(docs: DataFrame, hashes: DataFrame, sizes: list[int], window: int, block_bytes: int) -> DataFrame:
    """A row for each place ``at`` of a document whose shingle ``h`` (of ``s``
    words) is one of ``hashes``, with the words around it (``ctx``, from word
    ``lead``); and a row per document row with ``h`` null, ``doc_id``, ``n_words``."""
    words = docs.select(*doc_key(F.col("doc_id"), F.col("text")), "doc_id", lowered(F.col("text")).alias("text"))
    words = with_words(words, F.col("text"), SEPARATORS).select(*KEY, "doc_id", "w")
    none = F.lit(0).cast("long")                      # the hash of the row per document
    found = []
    for i, block in enumerate(_blocks(hashes, "h", block_bytes)):
        first = -1 if i == 0 else 0
        block = block.select("h").unionByName(hashes.sparkSession.range(1 if i == 0 else 0).select(none.alias("h")))
        x = words.filter(F.size("w") > 0) if first == 0 else words
        x = x.withColumn("at", F.explode(F.sequence(F.lit(first), F.size("w") - 1)))
        if len(sizes) < 2:
            x = x.withColumn("s", F.lit(sizes[0] if sizes else 1))
            x = x.withColumn("h", F.when(F.col("at") < 0, none).otherwise(_hash("w", F.col("at"), sizes[0] if sizes else 1)))
        else:                                         # short items: shingles of several sizes at a place
            each = [F.struct(F.lit(s).alias("s"), _hash("w", F.col("at"), s).alias("h")) for s in sizes]
            once = F.array(F.struct(F.lit(0).alias("s"), none.alias("h")))
            x = x.select("*", F.inline(F.when(F.col("at") < 0, once).otherwise(F.array(*each))))
        lead = F.greatest(F.col("at") - (window - F.col("s")), F.lit(0))
        x = x.join(F.broadcast(block.distinct()), "h").filter((F.col("at") < 0) | (F.col("at") + F.col("s") <= F.size("w")))
        head = F.col("at") < 0
        found.append(x.select(*KEY, F.when(head, F.col("doc_id")).alias("doc_id"), F.size("w").alias("n_words"), "at", "s",
                              F.when(~head, F.col("h")).alias("h"), F.when(~head, lead).alias("lead"),
                              F.when(~head, F.slice("w", lead + 1, 2 * window - F.col("s"))).alias("ctx")))
    return written(reduce(DataFrame.unionByName, found), "op5-places")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified occurrences (``_d, _t, start, n, wid``), the windows, and per
    document row its key, ``doc_id`` and ``n_words``.

    ``docs`` needs ``doc_id`` and ``text``; ``items`` ``item_id`` and ``text``.
    """
    windows = written(item_windows(items, window, shingle), "op5-windows")
    sized = windows.select("win", "wid", "n", F.least("n", F.lit(shingle)).alias("s"))
    sizes = [r[0] for r in sized.select("s").distinct().orderBy("s").collect()]       # at most ``shingle`` values
    hashed = F.coalesce(*[F.when(F.col("s") == s, _hash("win", F.col("p"), s)) for s in sizes or [1]])
    shingles = (sized.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("s"))))
                .withColumn("h", hashed))
    shingles = written(shingles, "op5-shingles")
    found = places(docs, shingles.select("h").distinct(), sizes, window, block_bytes)
    at = found.filter(F.col("h").isNotNull())
    # the rarest shingle of each window; a window with a shingle that no document has cannot occur
    counts = at.groupBy("s", "h").agg(F.count(F.lit(1)).alias("count"))
    of = Window.partitionBy("wid", "win")
    prefix = (shingles.join(counts, ["s", "h"])
              .withColumn("_rank", F.row_number().over(of.orderBy("count", "h", "p")))
              .withColumn("_have", F.count(F.lit(1)).over(of))
              .filter((F.col("_rank") == 1) & (F.col("_have") == F.col("n") - F.col("s") + 1)))
    prefix = written(prefix.select("win", "wid", "n", "s", "p", "h"), "op5-prefix")
    start = F.col("at") - F.col("p")
    hits = at.join(prefix, ["s", "h"]).filter((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    hits = hits.filter(F.slice("ctx", start - F.col("lead") + 1, F.col("n")) == F.col("win"))
    hits = written(hits.select(*KEY, start.alias("start"), "n", "wid").distinct(), "op5-hits")
    return hits, windows, found.filter(F.col("h").isNull()).select(*KEY, "doc_id", F.col("n_words").cast("long").alias("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: its key, ``doc_id``, ``n_words``, ``n_hit``
    (words inside occurrences), ``items`` (sorted ids), ``spans`` (maximal
    runs of hit words as structs of first word and length)."""
    found, windows, base = occurrences(docs, items, window, shingle, block_bytes)
    # maximal runs of hit words: a document's places in order
    per_doc = Window.partitionBy(*KEY).orderBy("start")
    runs = (found.groupBy(*KEY, "start").agg(F.max("n").alias("n"))
            .withColumn("_end", F.max(F.col("start") + F.col("n")).over(
                per_doc.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("_run", F.sum(F.when(F.col("start") <= F.col("_end"), 0).otherwise(1)).over(
                per_doc.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*KEY, "_run").agg(F.min("start").alias("first"),
                                       (F.max(F.col("start") + F.col("n")) - F.min("start")).alias("length")))
    spans = runs.groupBy(*KEY).agg(F.sum("length").alias("n_hit"),
                                   F.array_sort(F.collect_list(F.struct("first", "length"))).alias("spans"))
    # windows with the same items are one class, so a passage that many items
    # share is not multiplied by its windows
    classes = windows.select("wid", "items", F.xxhash64("items").alias("cls"))
    per_class = (found.select(*KEY, "wid").distinct().join(classes.select("wid", "cls"), "wid")
                 .select(*KEY, "cls").distinct())
    members = classes.select("cls", "items").dropDuplicates(["cls"])
    named = (per_class.join(members, "cls").select(*KEY, F.explode("items").alias("item")).distinct()
             .groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items")))
    out = base.join(spans.join(named, KEY, "left"), KEY, "left")
    return out.select(*KEY, "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      F.coalesce("spans", F.array().cast("array<struct<first:int,length:int>>")).alias("spans"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no window of an item."""
    hit = decontaminate(docs, items).filter(F.col("n_hit") > 0).select(*KEY).distinct()
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("row"), *doc_key(F.col("doc_id"), F.col("text")))
    return keyed.join(written(hit, "op5-drop"), KEY, "left_anti").select("row.*")


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns, derived from the operator's."""
    slim = docs.select("doc_id", "text")
    return decontaminate(slim, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
