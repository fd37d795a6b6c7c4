"""The corpus pipeline: five stages over ``documents``, each by one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet under the shared folder and reads it back as the next stage's docs,
so that every stage works on all its predecessor kept and a lost executor
repeats one stage at most. All but the last return the columns of documents.

1. language ID: texts without letters, and texts too far from every learned
   language, go. It learns from the labels of the rows it is given.
2. near duplicates: of each class of linked texts (and of copies) the row with
   the least id stays; rows that are equal to it go as well.
3. substring dedup: words inside windows that also start earlier are cut out of
   ``text``, with the white space after them; ``n_chars`` follows. Rows stay,
   also where no word is left.
4. benchmark decontamination: rows that hold a window of an item go.
5. byte-level BPE: ids of every text, their number and digests, and the check
   that they decode to the text.

Null texts have no language and go in stage 1. A null id comes after all
others. An empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm import bpe, decontaminate, jaccard_forest, langid, substring_dedup
from pitchside.llm.common import KEY, doc_key, fresh_path, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return langid.predict(docs, langid.fit(docs)).filter(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    rows = jaccard_forest.link(docs).select(*KEY, "root", "n_copies", "n_links").distinct()
    # the least row of each class, by id and then by text; texts without words are classes of their own
    alone = F.col("root").isNull() | ((F.col("n_copies") == 1) & (F.col("n_links") == 0))
    best = rows.filter(~alone).groupBy("root").agg(F.min(F.struct(*KEY)).alias("best"))
    stay = rows.filter(alone).select(*KEY).unionByName(best.select("best.*"))
    keyed = docs.select(*doc_key(F.col("doc_id"), F.col("text")), *COLUMNS)
    # equal rows share a key: one of them stays
    return keyed.join(written(stay, "near-stay"), KEY, "left_semi").dropDuplicates(KEY).select(*COLUMNS)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    changed = substring_dedup.changed(docs, substring_dedup.base_rows(docs)).select(*KEY, "text_left")
    keyed = docs.select(*doc_key(F.col("doc_id"), F.col("text")), *COLUMNS)
    out = keyed.join(changed, KEY, "left")
    chars = F.when(F.col("text_left").isNull(), F.col("n_chars")).otherwise(F.char_length("text_left"))
    return out.select("doc_id", F.coalesce("text_left", "text").alias("text"), "lang", "source", chars.cast("long").alias("n_chars"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    codec = bpe.ByteBPE(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = codec.round_trip(docs.select("doc_id", "lang", "source", "text"))
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", "lang", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
                      exact.alias("exact"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_text),
    ("decontamination", benchmark_free),
    ("byte_bpe", encoded),
]

#: Hashing, clustering and BPE are not expressible in SQL; tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
