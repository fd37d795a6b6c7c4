"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import itertools
import sys
import threading
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.session import scratch_path

#: Words as the contracts of substring dedup and quality rules take them.
SPACES = " \t\n\x0b\x0c\r"
_COUNT = itertools.count()
_LOCK = threading.Lock()


def ship(name: str) -> None:
    """Task code of a module travels by value: workers need no package path."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def task_state() -> dict:
    """A dictionary of the Python worker that outlives a task (workers are
    reused); code that travels by value has new globals in every task."""
    return vars(sys.modules.setdefault("pitchside_task_state", types.ModuleType("pitchside_task_state")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder under the shared scratch root (``spark.checkpoint.dir``)."""
    with _LOCK:
        n = next(_COUNT)
    return scratch_path(spark, "llm", f"{label}-{n}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write a step to the shared scratch root and read it back: cuts the
    lineage, survives lost executors, and gives the planner a known size."""
    path = path or fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (name + "_" * i for i in itertools.count()) if x.lower() not in taken)


def doc_key(id_col: Column, text: Column) -> list[Column]:
    """``_d`` and ``_t``: the identity of a row for joins, never null. Rows
    that share an id but not a text stay apart; equal rows share a key, and
    so share their (equal) results. A null id is told from any number by the
    hash."""
    return [F.coalesce(id_col.cast("long"), F.lit(2 ** 63 - 1)).alias("_d"),
            F.xxhash64(F.coalesce(text, F.lit("")), text.isNull(), id_col.isNull()).alias("_t")]


KEY = ["_d", "_t"]


def with_words(df: DataFrame, text: Column, separators: str, out: str = "w") -> DataFrame:
    """``df`` with the words of ``text`` (null: none). Splitting at runs of
    separators costs a third of extracting the words between them; a separator
    at either end leaves an empty part there, which is cut off."""
    df = df.withColumn(out, F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"))
    first = F.when(F.get(out, F.lit(0)) == "", 1).otherwise(0)
    last = F.when((F.size(out) > 1) & (F.element_at(out, -1) == ""), 1).otherwise(0)
    return df.withColumn(out, F.when(first + last == 0, F.col(out))
                         .otherwise(F.slice(out, first + 1, F.size(out) - first - last)))


def salted_left_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str],
                     salts: int = 16) -> DataFrame:
    """Left join for a ``left`` with hot keys: its rows of one key go to
    ``salts`` tasks by ``spread``; ``right`` (at most one row a key) is
    repeated once a salt."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [*on, "_salt"], "left").drop("_salt")
