"""Operator 2: licence scan by sentence rules.

Known sentences (``sentence_id``, ``sentence``) and ordered rules (``rule_id``,
``licence``, ``place``, ``sentence_id``) are tables of any size; ``learn`` makes
both from whole licence texts.

A text is cut into sentences; a sentence is normalised (A-Z lower case, every
run of other characters than a-z and 0-9 one space) and joined with the known
ones, which are normalised alike. A rule matches where its sentences follow one
another in order, with no other known sentence and at most ``gap`` unknown ones
between two of them. Matches are taken left to right without overlap, the
longest first where several begin at the same place. A known sentence outside a
rule's order licenses nothing.

Sentences end at ``. ! ? ; :`` before white space. Licence notes often stand on
a line of their own without a full stop before them, while licence texts are
wrapped; so every text is read twice: with a line end as a sentence end, and
with a line end as a space. The licences of both readings count.

DataFrame functions only. The sentences of the corpus are joined where they are
if the known ones are small enough for the planner to broadcast, and by a shuffle
of sentences otherwise; only known sentences go on. They meet per text (a digest
of it, so copies are one), are matched with the rules by their first sentence,
and the texts' results are joined to the rows.

Defined results: a null or empty text has no sentences and no licence; repeated
sentences match repeatedly and name their licence once; equal rules go to the
least ``rule_id``; known sentences with one normal form are one sentence; a
sentence without a letter or digit is never found, nor is a rule that has such a
one or names a sentence that is not in the table; rows stay as many as they were; an empty table of documents, sentences or rules
gives no licence; other columns pass through unless they have a result's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm.common import salted_left_join, written

GAP = 2

# Sentences of public licence texts and notes, and rules over them.
SENTENCES = {
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                 "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
                 "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
                  "of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
                 "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "gpl3-licensed": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software:",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                  "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                  "Free Software Foundation;",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                 "following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                  "disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                  "disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                   "products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                 "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-nc-licensed": "Licensed under CC BY-NC 4.0.",
    "cc-by-licensed": "Licensed under CC BY 4.0.",
    "cc-by-sa-licensed": "Licensed under CC BY-SA 4.0.",
    "rights-reserved": "All rights reserved.",
}
RULES = [
    ("Apache-2.0", ["apache-header", "apache-use", "apache-copy", "apache-as-is", "apache-see"]),
    ("Apache-2.0", ["apache-header", "apache-use"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms"]),
    ("GPL-3.0", ["gpl3-licensed"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms", "gpl2-version", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms", "gpl2-version"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-licensed"]),
    ("CC-BY-4.0", ["cc-by-licensed"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-licensed"]),
    ("proprietary", ["rights-reserved"]),
]
#: First of the characters that stand for sentences.
BASE = 0x4E00


def normal(sentence: str) -> str:
    """The normal form, on the driver."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in sentence)
    return " ".join("".join(c if "a" <= c <= "z" or "0" <= c <= "9" else " " for c in low).split())


def codes(sentences: dict[str, str]) -> dict[str, str]:
    """Character of each sentence identifier."""
    return {name: chr(BASE + i) for i, name in enumerate(sentences)}


def patterns(rules: list[tuple[str, list[str]]], sentences: dict[str, str], gap: int) -> tuple[str, dict[str, str]]:
    """One alternation over all rules, longest first, and the licence of each
    match less its unknown sentences."""
    code = codes(sentences)
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    between = f"_{{0,{gap}}}"
    licence: dict[str, str] = {}
    for name, sequence in rules:
        licence.setdefault("".join(code[s] for s in sequence), name)
    return "|".join(between.join(code[s] for s in sequence) for _, sequence in ordered), licence


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The fixed sentences and rules above as tables."""
    sentences = spark.createDataFrame(list(SENTENCES.items()), "sentence_id string, sentence string")
    rules = [(r, licence, place, s) for r, (licence, names) in enumerate(RULES) for place, s in enumerate(names)]
    return sentences, spark.createDataFrame(rules, "rule_id long, licence string, place int, sentence_id string")


def _plain(text: Column) -> Column:
    """A text of words of a-z and 0-9 with one space between them; \\x01 marks a
    sentence's end and \\x02 a line's. White space after a full stop is part of its end."""
    own = F.coalesce(text, F.lit(""))
    for mark in "\x01\x02":
        own = F.replace(own, F.lit(mark), F.lit(" "))
    marked = F.replace(F.regexp_replace(own, r"[.!?;:][ \t\r\n]+", "\x01"), F.lit("\n"), F.lit("\x02"))
    return F.lower(F.regexp_replace(marked, "[^a-zA-Z0-9\x01\x02]+", " "))      # ASCII only by now


def _readings(plain: Column) -> Column:
    """``reading`` (0: line ends end sentences, 1: they are spaces), ``pos`` and
    ``norm`` of the sentences that have a letter or digit."""
    lines = F.split(plain, " ?[\x01\x02][\x01\x02 ]*")
    wrapped = F.split(F.regexp_replace(plain, "[ \x02]+", " "), " ?\x01[\x01 ]*")

    def numbered(parts: Column, reading: int) -> Column:
        full = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")
        return F.transform(full, lambda s, i: F.struct(F.lit(reading).alias("reading"), i.alias("pos"), s.alias("norm")))

    return F.concat(numbered(lines, 0), numbered(wrapped, 1))


def _normal(sentence: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(sentence, "[^a-zA-Z0-9]+", " ")))


def learn(texts: DataFrame, licence: str = "licence", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Sentences and rules from whole licence texts: every different sentence of
    the wrapped reading is a known one, and a text's sequence is its licence's
    rule. Copies of a text are one rule."""
    rows = texts.select(F.col(licence).alias("licence"), F.col(text).alias("text")).filter("licence is not null").distinct()
    said = rows.select("licence", F.xxhash64("licence", "text").alias("rule_id"), F.inline(_readings(_plain(F.col("text")))))
    said = said.filter("reading = 1").withColumn("sentence_id", F.md5("norm"))
    return (said.select("sentence_id", F.col("norm").alias("sentence")).distinct(),
            said.select("rule_id", "licence", F.col("pos").alias("place"), "sentence_id"))


def _known(sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``norm, s`` of the different sentences, and ``sentence_id, s`` of all names."""
    names = sentences.select("sentence_id", _normal(F.col("sentence")).alias("norm")).filter("norm <> ''")
    names = names.withColumn("s", F.xxhash64("norm"))
    return names.select("norm", "s").distinct(), names.select("sentence_id", "s").distinct()


def _sequences(rules: DataFrame, names: DataFrame) -> DataFrame:
    """``first, sequence, licence, rule_id, size`` of the rules whose sentences are all known."""
    whole = rules.join(names, "sentence_id", "left").groupBy("rule_id", "licence").agg(
        F.sort_array(F.collect_list(F.struct("place", "s"))).alias("parts"))
    whole = whole.filter(~F.exists("parts", lambda p: p["s"].isNull())).withColumn("sequence", F.col("parts.s"))
    one = whole.groupBy("sequence").agg(F.min(F.struct("rule_id", "licence")).alias("rule"))
    return one.select("sequence", "rule.*", F.get("sequence", F.lit(0)).alias("first"), F.size("sequence").alias("size"))


def matches(docs: DataFrame, sentences: DataFrame, rules: DataFrame, text: str = "text", gap: int = GAP) -> DataFrame:
    """One row per reading of a text with a known sentence: ``k`` (digest of the
    text), ``reading``, ``n_known`` and ``found``, the matches of all rules by place:
    ``at`` (number of the first among the known sentences), ``size`` (negative),
    ``rule_id``, ``licence``, ``pos`` and ``last`` (sentence numbers)."""
    norms, names = _known(sentences)
    rules = written(_sequences(rules, names), "op2-rules")
    longest = rules.agg(F.max("size")).first()[0] or 1
    whole = F.coalesce(F.col(text), F.lit(""))
    # the plain form is a column of its own, as a generator would compute it once a reading
    said = docs.select(F.unhex(F.md5(whole.cast("binary"))).alias("k"), _plain(whole).alias("plain"))
    said = said.select("k", F.inline(_readings(F.col("plain"))))
    # written, the known sentences have a size: a small table is broadcast and the corpus stays where it is
    norms = written(norms, "op2-norms")
    hits = written(said.join(norms, "norm").select("k", "reading", "pos", "s"), "op2-hits")
    seq = hits.groupBy("k", "reading").agg(F.sort_array(F.collect_set(F.struct("pos", "s"))).alias("hits"))
    seq = written(seq.withColumn("n_known", F.size("hits").cast("long")), "op2-sequences")
    # from every known sentence on, as many as the longest rule has
    begun = seq.select("k", "reading", F.posexplode(F.transform("hits", lambda _, i: F.slice("hits", i + 1, F.lit(longest)))).alias("at", "ahead"))
    begun = begun.join(rules, F.get("ahead.s", F.lit(0)) == F.col("first"))
    begun = begun.filter(F.slice("ahead.s", F.lit(1), F.col("size")) == F.col("sequence"))
    span = F.slice("ahead.pos", F.lit(1), F.col("size"))
    close = F.forall(F.zip_with(F.slice(span, F.lit(2), F.lit(longest)), F.slice(span, F.lit(1), F.col("size") - 1), lambda b, a: b - a - 1 <= gap),
                     lambda x: x)
    found = begun.filter(close).groupBy("k", "reading").agg(F.sort_array(F.collect_set(F.struct(
        "at", (-F.col("size")).alias("size"), "rule_id", "licence", F.get(span, F.lit(0)).alias("pos"),
        F.element_at(span, -1).alias("last")))).alias("found"))
    return seq.select("k", "reading", "n_known").join(found, ["k", "reading"], "left")


def _taken(found: Column) -> Column:
    """Matches without overlap: their number ``n`` and the different ``names``."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("names"))

    def take(acc: Column, m: Column) -> Column:
        more = F.struct((m["at"] - m["size"]).alias("end"), (acc["n"] + 1).alias("n"),
                        F.array_union(acc["names"], F.array(m["licence"])).alias("names"))
        return F.when(m["at"] >= acc["end"], more).otherwise(acc)

    return F.aggregate(F.coalesce(found, F.array().cast("array<struct<at:int,size:int,rule_id:bigint,licence:string,pos:int,last:int>>")),
                       start, take)


def scan(docs: DataFrame, sentences: DataFrame | None = None, rules: DataFrame | None = None, text: str = "text",
         gap: int = GAP) -> DataFrame:
    """``docs`` with ``licences`` (sorted, distinct, of both readings), ``n_matches``
    and ``n_known`` (matches and known sentences, of the reading that has more)."""
    if sentences is None or rules is None:
        sentences, rules = tables(docs.sparkSession)
    read = matches(docs, sentences, rules, text, gap).withColumn("taken", _taken(F.col("found")))
    result = written(read.groupBy("k").agg(
        F.max("n_known").alias("n_known"), F.max("taken.n").alias("n_matches"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("taken.names")))).alias("licences")), "op2-results")
    results = ["licences", "n_matches", "n_known"]
    rows = docs.select(F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("k"), F.struct("*").alias("row"),
                       F.monotonically_increasing_id().alias("n"))
    out = salted_left_join(rows, result, ["k"], ["n"])
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in results],
                      F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
                      *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in results[1:]])


def licences(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", "n_known", F.size("licences").cast("long").alias("n_licences"), F.array_join("licences", ",").alias("licences"))


def oracle() -> str:
    """DuckDB's SQL from the same fixed values, by other means: a character per
    sentence, and one regular expression over all rules, instead of joins."""
    pattern, licence = patterns(RULES, SENTENCES, GAP)
    quoted = lambda pairs: "map {" + ", ".join(f"'{a}': '{b}'" for a, b in pairs) + "}"
    known = quoted((normal(t), codes(SENTENCES)[n]) for n, t in SENTENCES.items())
    named = quoted(licence.items())

    def sequence(line_end: str) -> str:
        low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        cut = f"regexp_replace({low}, '[.!?;:][ \\t\\r\\n]+', chr(1), 'g')"
        if line_end:
            cut = f"replace({cut}, chr(10), chr(1))"
        parts = f"string_split(regexp_replace({cut}, '[^a-z0-9\\x01]+', ' ', 'g'), chr(1))"
        return (f"array_to_string(list_transform(list_filter(list_transform({parts}, lambda s: trim(s)), lambda s: s <> ''), "
                f"lambda s: coalesce(known[s], '_')), '')")

    found = lambda c: (f"list_transform(regexp_extract_all({c}, '{pattern}'), "  # noqa: E731
                       "lambda m: named[replace(m, '_', '')])")
    return f"""
with fixed as (select {known} as known, {named} as named),
s as (select doc_id, named, {sequence('line')} as a, {sequence('')} as b from documents, fixed),
f as (select doc_id, a, b, list_sort(list_distinct(list_concat({found('a')}, {found('b')}))) as l from s)
select doc_id, greatest(length(replace(a, '_', '')), length(replace(b, '_', ''))) as n_known,
       cast(len(l) as bigint) as n_licences, array_to_string(l, ',') as licences
from f
"""
