"""Physical layout of the ``matches`` table.

Directories: ``season=<s>/bucket=<b>`` with ``bucket = pmod(xxhash64(competition), buckets)``.
The number of buckets is a property of the table. A league-season lives in
exactly one directory, so

* an ingest rewrites only the directories its rows touch (a poll reads one
  competition, hence one bucket of one or two seasons), and
* a matchweek refresh inside those directories sees every match it needs.

Inside a directory rows are sorted by (competition, kickoff), so filters on
competition and dates prune parquet row groups. The directory count is
bounded by seasons x buckets, whatever the number of competitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchside.schema import MATCH_COLUMNS, MATCHES

BUCKETS = 16
PARTITION = ["season", "bucket"]
#: Order of rows inside a directory, for row-group pruning.
MATCH_ORDER = ["competition", "kicks_off_at", "id"]


def bucket_of(competition: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(competition), F.lit(buckets)).cast("int")


def write_matches(matches: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write rows into ``path``, which must be new. The rows are dealt by directory;
    adaptive execution splits a hot one over many writers and merges small ones.

    ``buckets=0`` is the read-optimised layout of a table that is built once
    and never rewritten in part (season folders only, fewer files).
    """
    parts = PARTITION if buckets else ["season"]
    df = matches.select(MATCH_COLUMNS)
    if buckets:
        df = df.withColumn("bucket", bucket_of(F.col("competition"), buckets))
    (df.hint("rebalance", *parts).sortWithinPartitions(*parts, *MATCH_ORDER)
     .write.mode("errorifexists").partitionBy(*parts).parquet(path))


STORED = T.StructType(MATCHES.fields + [T.StructField("bucket", T.IntegerType())])


def read_matches(spark: SparkSession, path: str, keep_partition: bool = False) -> DataFrame:
    """Fixed schema (partition columns included), so an empty table reads as empty."""
    df = spark.read.schema(STORED).parquet(path)
    return df.select(*MATCH_COLUMNS, *(["bucket"] if keep_partition else []))
