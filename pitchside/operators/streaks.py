"""Current streaks (win, unbeaten, winless, clean sheet) per club.

streak = recency of the nearest breaking match - 1; no breaking match -> the
whole count. One ranked pass per club, then a single hash aggregate whose
four ``min(case when ...)`` expressions share the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.operators.club_matches import CLUB, club_matches
from pitchside.operators.standings import attach_teams
from pitchside.plans.options import StandingsOptions


def _streak(breaks: Column) -> Column:
    n = F.count(F.lit(1))
    return (F.coalesce(F.min(F.when(breaks, F.col("recency"))), n + 1) - 1).cast("int")


def streak_aggs() -> list[Column]:
    """The four streaks, over rows that carry ``recency``."""
    o = F.col("outcome")
    return [_streak(o != "W").alias("win_streak"), _streak(o == "L").alias("unbeaten_streak"),
            _streak(o == "W").alias("winless_streak"), _streak(F.col("goals_against") != 0).alias("clean_sheet_streak")]


def streaks(matches: DataFrame, teams: DataFrame,
            opts: StandingsOptions = StandingsOptions()) -> DataFrame:
    """Options used: competition, season, venue, opponents (no upto, no last N)."""
    cm = club_matches(matches, opts.with_(upto_match=None, last_n=None), recency=True)
    agg = cm.groupBy(*CLUB).agg(F.count(F.lit(1)).cast("int").alias("played"), *streak_aggs())
    return attach_teams(agg, teams, ["name", "short_name"]).select(
        *CLUB, "name", "short_name", "played", "win_streak", "unbeaten_streak",
        "winless_streak", "clean_sheet_streak")
