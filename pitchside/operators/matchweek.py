"""Derived matchweek = games-played index of the later-playing club.

Per match, the max over its two clubs of the club's running match number
(kickoff, id order) inside (competition, season). Cancelled matches consume no
slot; postponed ones do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.operators.ranking import kickoff_slice, running_number


def _numbered(matches: DataFrame) -> DataFrame:
    """Club rows of the matches that count, with the club's running number."""
    fan = (matches.filter(F.col("status") != "cancelled")
           .select("id", "competition", "season", "kicks_off_at",
                   F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")))
    # in slices of kickoff time: a club-season of any size is numbered over many tasks
    return running_number(fan, ["competition", "season", "team_id"],
                          [F.col("kicks_off_at"), F.col("id")], "nth", kickoff_slice(F.col("kicks_off_at")))


def derived_matchweeks(matches: DataFrame) -> DataFrame:
    """(id, competition, season, matchweek) for every non-cancelled match."""
    # the league is a function of the id; as keys, not as values, it keeps the
    # aggregate a hash aggregate
    return _numbered(matches).groupBy("id", "competition", "season").agg(F.max("nth").cast("int").alias("matchweek"))


def match_numbers(matches: DataFrame) -> DataFrame:
    """(id, matchweek), partitioned by id alone as a join back needs it."""
    return _numbered(matches).groupBy("id").agg(F.max("nth").cast("int").alias("matchweek"))


def with_matchweeks(matches: DataFrame) -> DataFrame:
    """Materialise D1 into ``matches.matchweek``.

    A cancelled match leaves the derivation and keeps its stored number
    (``coalesce(derived, stored)``), exactly as the set-based update does.
    """
    d = match_numbers(matches).withColumnRenamed("matchweek", "_derived")
    return (matches.join(d, "id", "left")
            .withColumn("matchweek", F.coalesce("_derived", "matchweek"))
            .select(matches.columns))


def matchweek_changes(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows whose matchweek differs (``is distinct from``) between two states."""
    a = stored.select("id", F.col("matchweek").alias("old"))
    b = recomputed.select("id", "competition", "season", F.col("matchweek").alias("new"))
    return b.join(a, "id", "left").filter(~F.col("old").eqNullSafe(F.col("new")))
