"""The league tables a query reads: ``teams`` (with slug) and ``matches``
(with the materialised matchweek).

They are derived once per Spark application and input folder, and written as
parquet under the shared scratch root (``spark.checkpoint.dir``): the written
table cuts lineage, survives executor loss, and gives every later query
partition pruning (season directories) and min/max pruning (rows sorted by
competition and kickoff inside each season). Ingest tables (snapshots) use
the (season, bucket) layout instead, so a poll rewrites only what it touches.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions.slug import slugify
from pitchside.operators.matchweek import with_matchweeks
from pitchside.sources.storage import read_matches, write_matches
from pitchside.session import app_id, configure, scratch_path
from pitchside.sources.league import raw_league


@dataclass(frozen=True)
class League:
    teams: DataFrame
    matches: DataFrame
    path: str


_CACHE: dict[tuple[str, str], League] = {}
_LOCK = threading.RLock()


def enrich_teams(teams: DataFrame) -> DataFrame:
    return teams.withColumn("slug", slugify(F.col("name")))


def build_league(spark: SparkSession, sf_dir: str, path: str) -> League:
    teams, matches = raw_league(spark, sf_dir)
    enrich_teams(teams).write.parquet(f"{path}/teams")
    write_matches(with_matchweeks(matches), f"{path}/matches", buckets=0)
    return League(spark.read.parquet(f"{path}/teams"), read_matches(spark, f"{path}/matches"), path)


def league(spark: SparkSession, sf_dir: str) -> League:
    """Teams and matches for ``sf_dir``, built at most once per application."""
    configure(spark)
    key = (app_id(spark), sf_dir.rstrip("/"))
    with _LOCK:
        if key not in _CACHE:
            digest = hashlib.sha1(key[1].encode()).hexdigest()[:12]
            path = scratch_path(spark, "league", key[0], f"{digest}-{uuid.uuid4().hex[:8]}")
            _CACHE[key] = build_league(spark, sf_dir, path)
        return _CACHE[key]
