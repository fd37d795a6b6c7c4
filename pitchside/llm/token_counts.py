"""Operator 1: token-count rollups that are maintained by deltas.

A rollup holds documents and tokens by source, language and tokenizer version.
It is never recounted: changes come as signed rows - an insert is +1, a delete
is -1, a revised count is -1 of the old row and +1 of the new one - and totals
are the sums of what the batches add.

* ``counted`` counts tokens (in Arrow batches, with the tiktoken library).
* ``signed`` compares two states of a ledger of counted documents and gives the
  signed rows; equal rows cancel out before anything is written.
* ``Rollup.commit`` adds the signed rows of a batch, pre-aggregated per group,
  under the batch's name. Its table is written to a folder of its own; then a
  marker named after the batch is created if absent. A batch that is committed
  again (a retry, a replay) finds its marker and changes nothing, whatever it
  carries; a writer that fails before the marker leaves nothing that is read.
* ``Rollup.totals`` sums the committed batches; ``compact`` folds them into one
  base table, so a long history is not read again and again.

Groups are few, their partial sums combine before the shuffle: a source with a
third of all documents costs as much as any other.

Defined results: null source, language or version are groups of their own; a
null or empty text has no tokens but is a document; repeated rows count each;
groups without documents and tokens are left out of the totals; an empty table
or batch adds nothing (its marker is set all the same); extra columns are not
looked at. Sums of tokens are long.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm.bpe import read_ranks, vocabulary_key
from pitchside.llm.common import KEY, doc_key, salted_left_join, ship, task_state, written
from pitchside.sources import files

ship(__name__)

GROUP = ["source", "lang", "tokenizer"]
LEDGER = [*KEY, *GROUP, "n_tokens"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def token_counter(spark: SparkSession, rank_file: str, pattern: str):
    """A column function: tokens of a text by a rank file, without special
    tokens. The file is read on the driver and broadcast (about a megabyte)."""
    ranks = spark.sparkContext.broadcast(read_ranks(rank_file))
    name = f"counter {vocabulary_key(rank_file, pattern)}"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        state = task_state()
        if name not in state:
            import tiktoken

            state[name] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        encode = state[name].encode_ordinary
        for texts in batches:
            yield pa.array([len(encode(x.as_py() or "")) for x in texts], pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long")


def counted(docs: DataFrame, tokenizer: str, counter) -> DataFrame:
    """The ledger rows of ``docs`` (``doc_id, text, source, lang``) under one
    tokenizer version."""
    return docs.select(*doc_key(F.col("doc_id"), F.col("text")), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"),
                       counter(F.col("text")).alias("n_tokens"))


def signed(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Signed rows that turn one state of the ledger into another. A row that
    both have (or have equally often) is not among them."""
    parts = [df.select(*LEDGER, F.lit(sign).alias("sign")) for df, sign in ((before, -1), (after, 1)) if df is not None]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if len(parts) == 1:
        return rows
    return rows.groupBy(*LEDGER).agg(F.sum("sign").alias("sign")).filter(F.col("sign") != 0)


class Rollup:
    """A rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add the signed rows of a batch; False if it is committed already."""
        marker = f"{self.root}/commits/{batch}.json"
        if files.exists(self.spark, marker) or batch in self._folded():
            return False
        folder = f"batches/{batch}-{uuid.uuid4().hex[:12]}"
        sums = rows.groupBy(*GROUP).agg(F.sum(F.col("sign").cast("long")).alias("n_docs"),
                                        F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        sums.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0)).repartition(1).write.parquet(f"{self.root}/{folder}")
        return files.create_new(self.spark, marker, json.dumps({"batch": batch, "folder": folder}))

    def _base(self) -> dict:
        """The newest base: its table and the batches folded into it."""
        found = [n for n in files.names(self.spark, f"{self.root}/bases") if n.endswith(".json")]
        return json.loads(files.read_text(self.spark, f"{self.root}/bases/{found[-1]}")) if found else {"n": 0, "batches": []}

    def _folded(self) -> set[str]:
        return set(self._base()["batches"])

    def _pending(self, base: dict) -> list[dict]:
        done = set(base["batches"])
        found = [n.removesuffix(".json") for n in files.names(self.spark, f"{self.root}/commits") if n.endswith(".json")]
        return [json.loads(files.read_text(self.spark, f"{self.root}/commits/{b}.json")) for b in found if b not in done]

    def _tables(self, base: dict, pending: list[dict]) -> DataFrame:
        paths = [f"{self.root}/{x}" for x in ([base["folder"]] if "folder" in base else []) + [p["folder"] for p in pending]]
        rows = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        return (rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0)))

    def totals(self) -> DataFrame:
        base = self._base()
        return self._tables(base, self._pending(base))

    def compact(self) -> bool:
        """Fold all committed batches into a new base; False if another writer
        made that base first."""
        base = self._base()
        pending = self._pending(base)
        folder = f"bases/{base['n'] + 1:09d}-{uuid.uuid4().hex[:12]}"
        self._tables(base, pending).repartition(1).write.parquet(f"{self.root}/{folder}")
        text = json.dumps({"n": base["n"] + 1, "folder": folder, "batches": base["batches"] + [p["batch"] for p in pending]})
        return files.create_new(self.spark, f"{self.root}/bases/{base['n'] + 1:09d}.json", text)


def less_copies(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger's rows that stay and those that go when each text keeps its
    least id only. A text with very many copies is spread over tasks."""
    least = ledger.groupBy("_t").agg(F.min("_d").alias("_least"), F.max("_d").alias("_most"))
    least = least.filter(F.col("_most") > F.col("_least")).select("_t", "_least")
    marked = salted_left_join(ledger, least, ["_t"], ["_d"])
    copy = F.coalesce(F.col("_d") > F.col("_least"), F.lit(False))
    return marked.filter(~copy).select(*LEDGER), marked.filter(copy).select(*LEDGER)


def maintain(docs: DataFrame, root: str, first: tuple[str, str], second: tuple[str, str], languages: list[str],
             pattern: str) -> Rollup:
    """The life of a rollup over a whole table of documents:

    * ``load`` inserts all documents under the ``first`` tokenizer version;
    * ``dedup`` deletes the copies: rows whose text a smaller id has;
    * ``retokenise`` revises the counts of ``languages`` to the ``second``
      version.

    Each batch is committed twice, as a retry would; the second has no effect.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "source", "lang")
    one, two = (token_counter(spark, path, pattern) for _, path in (first, second))
    loaded = written(counted(docs, first[0], one), "op1-ledger")
    stay, gone = less_copies(loaded)
    stay, gone = written(stay, "op1-ledger"), written(gone, "op1-copies")
    chosen = F.col("lang").isin(languages)
    revised = counted(docs.filter(chosen), second[0], two).join(stay.select(*KEY).distinct(), KEY, "left_semi")
    rollup = Rollup(spark, root)
    for batch, rows in (("load", signed(None, loaded)), ("dedup", signed(gone, None)),
                        ("retokenise", signed(stay.filter(chosen), revised))):
        rollup.commit(batch, rows)
        rollup.commit(batch, rows)
    return rollup
