"""Fan-out (B1), outcome (B2), match filters (B3-B7), recency (B8), last N.

One row per club per match is the basis of every statistic. Match predicates
(competition, season, played, matchweek, mini-league) are applied to the match
row *before* the fan-out so Catalyst pushes them into the scan; the venue
choice decides which sides are generated at all; recency is a window over
whatever survived (the reference's order of operations).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.operators.ranking import kickoff_slice, running_number
from pitchside.plans.options import StandingsOptions

LEAGUE = ["competition", "season"]
CLUB = ["competition", "season", "team_id"]


def outcome(goals_for: Column, goals_against: Column) -> Column:
    return (F.when(goals_for > goals_against, "W")
            .when(goals_for == goals_against, "D").otherwise("L"))


def _side(side: str) -> Column:
    other = "away" if side == "home" else "home"
    return F.struct(
        F.col(f"{side}_team_id").alias("team_id"),
        F.col(f"{other}_team_id").alias("opponent_id"),
        F.col(f"{side}_goals").alias("goals_for"),
        F.col(f"{other}_goals").alias("goals_against"),
        F.lit(side).alias("venue"),
    )


def fan_out(matches: DataFrame, keep: list[str], venue: str = "all") -> DataFrame:
    """Each match -> one row per requested side, goals from that club's view."""
    sides = ["home", "away"] if venue == "all" else [venue]
    if len(sides) == 1:
        return matches.select(*keep, _side(sides[0]).alias("c")).select(*keep, "c.*")
    return matches.select(*keep, F.inline(F.array(*[_side(s) for s in sides])))


def played(matches: DataFrame) -> DataFrame:
    """Finished with both scores present."""
    return matches.filter((F.col("status") == "finished")
                          & F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull())


def scope(matches: DataFrame, competition: str | None, season: int | None) -> DataFrame:
    """B3 on the partition / sort columns; None keeps every league or season."""
    if competition is not None:
        matches = matches.filter(F.col("competition") == competition)
    if season is not None:
        matches = matches.filter(F.col("season") == season)
    return matches


def mini_league(matches: DataFrame, opponents) -> DataFrame:
    """Both clubs in the set; empty set = no filter.

    A DataFrame set is per (competition, season). Each side is a semi join on
    (league, club), so a league with very many matches is spread over its
    clubs; a league without a row in the set has an empty set and keeps all its
    matches. No pairs are formed.
    """
    if opponents is None:
        return matches
    if isinstance(opponents, DataFrame):
        members = opponents.select(*CLUB).distinct()
        leagues = opponents.select(*LEAGUE, F.lit(True).alias("_has_set")).distinct()
        for side in ("home", "away"):
            inside = members.select(*LEAGUE, F.col("team_id").alias(f"{side}_team_id"), F.lit(True).alias(f"_{side}_in"))
            matches = matches.join(inside, [*LEAGUE, f"{side}_team_id"], "left")
        matches = matches.join(leagues, LEAGUE, "left")
        both = F.col("_home_in").isNotNull() & F.col("_away_in").isNotNull()
        return matches.filter(F.col("_has_set").isNull() | both).drop("_home_in", "_away_in", "_has_set")
    ids = list(opponents)
    if not ids:
        return matches
    return matches.filter(F.col("home_team_id").isin(ids) & F.col("away_team_id").isin(ids))


def recency_window() -> Window:
    return Window.partitionBy(*CLUB).orderBy(F.col("kicks_off_at").desc(), F.col("id").desc())


def most_recent(cm: DataFrame, n: int) -> DataFrame:
    """Each club's n most recent rows, with ``recency``.

    ``row_number() <= n`` is planned as a WindowGroupLimit that also runs
    before the shuffle, so a club with many rows is cut to n per map task.
    """
    return cm.withColumn("recency", F.row_number().over(recency_window())).filter(F.col("recency") <= n)


def with_recency(cm: DataFrame) -> DataFrame:
    """Recency on every row (streaks need all of them), numbered in slices."""
    return running_number(cm, CLUB, [F.col("kicks_off_at").desc(), F.col("id").desc()], "recency",
                          kickoff_slice(F.col("kicks_off_at")), falling=True)


def club_matches(matches: DataFrame, opts: StandingsOptions = StandingsOptions(),
                 recency: bool = False) -> DataFrame:
    """B1-B9 composed. ``recency`` forces the rank column even without last N."""
    m = scope(played(matches), opts.competition, opts.season)
    if opts.upto_match is not None:
        m = m.filter(F.col("matchweek") <= opts.upto_match)
    m = mini_league(m, opts.opponents)
    cm = fan_out(m, ["id", "competition", "season", "matchweek", "kicks_off_at"], opts.venue)
    cm = cm.withColumn("outcome", outcome(F.col("goals_for"), F.col("goals_against")))
    if opts.last_n is not None:
        return most_recent(cm, opts.last_n)
    return with_recency(cm) if recency else cm
