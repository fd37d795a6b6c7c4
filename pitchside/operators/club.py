"""L1 latest season, C1 slug lookup, C2 fixtures, C3 next fixture,
C4 club profile (one row per club, all clubs in one job), C5 results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.functions.feed import season_label
from pitchside.operators.club_matches import CLUB, LEAGUE, club_matches, fan_out, outcome
from pitchside.operators.head_to_head import head_to_head, pair_record
from pitchside.operators.standings import (
    attach_teams, form_agg, points, rank_league, side_aggs, side_positions, total_aggs)
from pitchside.operators.streaks import streak_aggs
from pitchside.plans.options import StandingsOptions
from pitchside.schema import FORM_WINDOW


def latest_season(matches: DataFrame) -> DataFrame:
    """L1 per competition: max season with a finished match (scores not
    required); null when the competition has none."""
    return (matches.groupBy("competition")
            .agg(F.max(F.when(F.col("status") == "finished", F.col("season"))).alias("season"))
            .withColumn("season_label", season_label(F.col("season"))))


def slugs(teams: DataFrame) -> DataFrame:
    """C1 support: every club's slug; the first club (lowest id) owns a slug,
    collisions are counted. Aggregate-and-join, so a slug shared by many clubs
    is combined map-side rather than ranked in one task."""
    owners = teams.groupBy("slug").agg(F.min("id").alias("_owner"),
                                       F.count(F.lit(1)).cast("int").alias("slug_collisions"))
    return (teams.join(owners, "slug")
            .select("id", "name", "slug", (F.col("id") == F.col("_owner")).alias("owns_slug"),
                    "slug_collisions"))


def find_club(teams: DataFrame, slug: str) -> DataFrame:
    """The first club whose name slugs to ``slug`` (0 or 1 row)."""
    return teams.filter(F.col("slug") == slug).orderBy("id").limit(1)


def find_clubs(teams: DataFrame, requests: DataFrame) -> DataFrame:
    """C1 for many requests (``slug`` and other columns) at once: the club that
    owns the slug, null where there is none."""
    owners = teams.groupBy("slug").agg(F.min(F.struct("id", "name")).alias("o")).select(
        "slug", F.col("o.id").alias("team_id"), F.col("o.name").alias("name"))
    return requests.join(owners, "slug", "left")


def club_fixtures(matches: DataFrame, teams: DataFrame,
                  competition: str | None = None, season: int | None = None) -> DataFrame:
    """Every status, from the club's side, opponent name + slug; outcome
    only for finished and scored matches."""
    m = matches
    if competition is not None:
        m = m.filter(F.col("competition") == competition)
    if season is not None:
        m = m.filter(F.col("season") == season)
    cm = fan_out(m, ["id", "competition", "season", "matchweek", "kicks_off_at", "status"])
    scored = (F.col("status") == "finished") & F.col("goals_for").isNotNull() & F.col("goals_against").isNotNull()
    opp = teams.select(F.col("id").alias("opponent_id"), F.col("name").alias("opponent_name"),
                       F.col("slug").alias("opponent_slug"))
    return (cm.join(opp, "opponent_id")
            .withColumn("outcome", F.when(scored, outcome(F.col("goals_for"), F.col("goals_against"))))
            .select("competition", "season", "team_id", "id", "matchweek", "kicks_off_at", "status",
                    "venue", "opponent_id", "opponent_name", "opponent_slug", "goals_for",
                    "goals_against", "outcome"))


def results_list(fixtures: DataFrame) -> DataFrame:
    """C5."""
    return fixtures.filter(F.col("outcome").isNotNull())


def next_fixture(matches: DataFrame, teams: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """C3 per (competition, club): earliest scheduled or live match at or after
    ``now``, any season; id breaks kickoff ties. ``min_by`` is a partial
    aggregate, so even a club with a huge backlog is reduced map-side."""
    now_col = now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")
    m = matches.filter(F.col("status").isin("scheduled", "live") & (F.col("kicks_off_at") >= now_col))
    cm = fan_out(m, ["id", "competition", "kicks_off_at"])
    nxt = (cm.groupBy("competition", "team_id")
           .agg(F.min_by(F.struct("id", "kicks_off_at", "venue", "opponent_id"),
                         F.struct("kicks_off_at", "id")).alias("n"))
           .select("competition", "team_id", "n.*"))
    opp = teams.select(F.col("id").alias("opponent_id"), F.col("name").alias("opponent_name"),
                       F.col("slug").alias("opponent_slug"))
    return nxt.join(opp, "opponent_id").select(
        "competition", "team_id", "id", "kicks_off_at", "venue", "opponent_id", "opponent_name",
        "opponent_slug")


def club_profile(matches: DataFrame, teams: DataFrame, now: dt.datetime,
                 opts: StandingsOptions = StandingsOptions()) -> DataFrame:
    """C4: position of n, points, form-6 record, streaks, home/away split and
    the next opponent's head-to-head, one row per club and league-season.

    One fan-out with recency, and one aggregate per club with conditional
    columns for everything that a club's own matches say; positions are ranked
    over these per-club rows. Only the next fixture and the pair records are
    frames of their own.
    """
    cm = club_matches(matches, opts.with_(upto_match=None, last_n=None, venue="all"), recency=True)
    o, v, r = F.col("outcome"), F.col("venue"), F.col("recency")
    last6 = r <= FORM_WINDOW
    count = lambda c: F.count_if(c).cast("int")
    per_club = cm.groupBy(*CLUB).agg(
        *total_aggs(), form_agg().alias("form"), *streak_aggs(), *side_aggs(),
        count(last6 & (o == "W")).alias("form6_won"), count(last6 & (o == "D")).alias("form6_drawn"),
        count(last6 & (o == "L")).alias("form6_lost"))
    per_club = per_club.withColumns({
        "goal_difference": (F.col("goals_for") - F.col("goals_against")).cast("int"),
        "points": points(F.col("won"), F.col("drawn")),
        "form6_points": points(F.col("form6_won"), F.col("form6_drawn"))})
    ranked = side_positions(rank_league(attach_teams(per_club, teams, ["name", "slug"])))
    both = (F.col("home_played") > 0) & (F.col("away_played") > 0)
    table = ranked.select(
        *CLUB, "name", "slug", "position", "played", "points", "form",
        F.count(F.lit(1)).over(Window.partitionBy(*LEAGUE)).cast("int").alias("clubs"),
        "form6_won", "form6_drawn", "form6_lost", "form6_points",
        "win_streak", "unbeaten_streak", "winless_streak", "clean_sheet_streak",
        *[F.when(both, F.col(c)).alias(c) for c in ("home_position", "home_points", "away_position", "away_points")])
    nxt = next_fixture(matches, teams, now).select(
        "competition", "team_id", F.col("opponent_id").alias("next_opponent_id"),
        F.col("kicks_off_at").alias("next_kicks_off_at"), F.col("venue").alias("next_venue"))
    pairs = nxt.select("competition", F.col("team_id").alias("team_a_id"),
                       F.col("next_opponent_id").alias("team_b_id"))
    rec = pair_record(head_to_head(matches), pairs).select(
        "competition", F.col("team_a_id").alias("team_id"),
        F.col("team_b_id").alias("next_opponent_id"),
        F.col("played").alias("h2h_played"), F.col("team_a_wins").alias("h2h_wins"),
        F.col("draws").alias("h2h_draws"), F.col("team_b_wins").alias("h2h_losses"))
    ahead = nxt.join(rec, ["competition", "team_id", "next_opponent_id"], "left")
    return table.join(ahead, ["competition", "team_id"], "left")
