"""Operator 9: quality rules with cross-document line frequency.

DataFrame functions only. Base measures per document, all within its row: words
(runs of anything but ASCII white space), code points in words, symbols,
repeated lines, and words inside ``REPEAT_WINDOW``-word windows that occur
twice or more in the text. A document fails the base rules if it has too few
words or too many repeated ones.

The method's rule looks across documents: lines are normalised (A-Z lower case,
digit runs as 0, white space collapsed) and hashed; for each host (the source)
the documents that have a line are counted, one per document. A line is over
the limit if more than ``max(min_docs, share * documents of the host)`` have it.
Such lines are removed, and a document that keeps less than ``keep`` of its
words is depleted and rejected.

Texts are read once: a row's measures and the hashes and word counts of its lines
are written, and everything after works on these. (host, line, document) triples
are made distinct first, spread by all three; what is counted then is
pre-aggregated, and only lines over the limit (a written table, of at most
``lines per document / share`` lines a host) meet the documents again, so
neither a common line nor a large host gathers in one task.

Defined results: a null text has no words and no lines (it fails the base
rules); an empty line is no line; a null source is a host of its own; rows that
share an id are one document where documents are counted (rows without an id
are one as well), and are judged apart; equal rows get equal results; an empty
table gives an empty result; columns beyond id, text and source are not looked
at. Windows and lines are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import KEY, doc_key, with_words, written
from pitchside.llm.decontaminate import lowered

SPACE = r"\x20\x09-\x0D"
SYMBOLS = r"[#*$%&|<>]"
REPEAT_WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
MIN_DOCS, SHARE, KEEP = 20, 0.1, 0.5


def normal_lines(text: Column) -> Column:
    """The lines of a text that have a word, normalised."""
    flat = F.regexp_replace(F.regexp_replace(lowered(text), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.transform(F.split(F.coalesce(flat, F.lit("")), "\n"), lambda s: F.trim(s))
    return F.filter(lines, lambda x: x != "")


def measures(docs: DataFrame, window: int = REPEAT_WINDOW) -> DataFrame:
    """Key, id, host, the base measures and ``norm``, the normalised lines as
    (hash ``line``, ``n`` words), one row per document row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaces = lambda s: F.char_length(s) - F.char_length(F.replace(s, F.lit(" "))) + 1
    norm = F.transform(normal_lines(F.col("text")), lambda s: F.struct(F.xxhash64(s).alias("line"), spaces(s).alias("n")))
    x = docs.select(*doc_key(F.col("doc_id"), F.col("text")), "doc_id", F.col("source").alias("host"), text.alias("text"), norm.alias("norm"))
    x = with_words(x, F.col("text"), SPACE)
    hashes = F.transform(F.sequence(F.lit(1), F.size("w") - window + 1), lambda i: F.xxhash64(F.slice("w", i, window)))
    lines = F.filter(F.split("text", "\n"), lambda s: F.regexp_like(s, F.lit(r"[^\x20\x09-\x0D]")))
    x = x.select(*KEY, "doc_id", "host", "norm", F.size("w").cast("long").alias("n_words"),
                 F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("lines"),
                 F.when(F.size("w") >= window, hashes).alias("h"))
    # only a text with a repeated window has its windows sorted, equal ones together
    pairs = F.transform("h", lambda v, i: F.struct(v.alias("v"), i.alias("at")))
    x = x.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(pairs)))
    twin = lambda e, i: ((F.get("s", i - 1)["v"] == e["v"]) & (i > 0)) | (
        F.coalesce(F.get("s", i + 1)["v"] == e["v"], F.lit(False)))
    x = x.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda e, i: F.coalesce(twin(e, i), F.lit(False))),
                                                   lambda e: e["at"])))
    covered = F.aggregate(F.transform("p", lambda a, i: F.least(F.coalesce(F.get("p", i + 1) - a, F.lit(window)), F.lit(window))),
                          F.lit(0).cast("long"), lambda acc, v: acc + v)
    return x.select(*KEY, "doc_id", "host", "norm", "n_words", "word_chars", "n_symbols",
                    (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                    F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """``host, line`` (hash) and ``n`` of the lines over their host's limit, from
    rows as ``measures`` makes them."""
    doc = [F.col("doc_id").isNull().alias("_none"), "_d"]
    held = rows.select("host", *doc, F.explode(F.array_distinct(F.col("norm.line"))).alias("line")).distinct()
    count = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)
    hosts = rows.select(F.col("host").alias("_host"), *doc).distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("n_docs"))
    return (count.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).filter(F.col("n") > share * F.col("n_docs"))
            .select("host", "line", "n"))


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, keep: float = KEEP) -> DataFrame:
    """One row per document row: the base measures, ``n_removed_words`` and
    ``n_removed_lines`` (in lines over the limit), ``base_failed`` and ``kept``."""
    rows = written(measures(docs.select("doc_id", "text", "source")), "op9-rows")
    frequent = written(frequent_lines(rows, min_docs, share), "op9-frequent")
    common = frequent.select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    # equal rows of a host share a key and so their figures: one of them is looked at
    lines = rows.select(*KEY, "host", "norm").dropDuplicates([*KEY, "host"]).select(*KEY, "host", F.inline("norm"))
    hit = lines.join(common, (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host")))
    removed = hit.groupBy(*KEY, F.col("host").alias("_h")).agg(F.sum("n").alias("n_removed_words"), F.count(F.lit(1)).alias("n_removed_lines"))
    base = rows.drop("norm")
    out = base.join(removed, [base[k] == removed[k] for k in KEY] + [F.col("host").eqNullSafe(F.col("_h"))], "left")
    out = out.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     F.coalesce("n_removed_words", F.lit(0)).cast("long").alias("n_removed_words"),
                     F.coalesce("n_removed_lines", F.lit(0)).alias("n_removed_lines"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    depleted = F.col("n_words") - F.col("n_removed_words") < keep * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def verdicts(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the words and lines that would go."""
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept", "n_removed_words", "n_removed_lines")
