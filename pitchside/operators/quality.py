"""Q1-Q10: data-quality and audit jobs. Each is an aggregate over the
tables or over a statistic, one row per league-season unless stated."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchside.operators.club_matches import CLUB, LEAGUE, club_matches, played
from pitchside.operators.ranking import kickoff_slice, running_sums, week_slice


def feed_health(matches: DataFrame, teams: DataFrame, now: dt.datetime) -> DataFrame:
    """Q1: counts, newest update and its age in whole minutes (half up)."""
    m = matches.agg(F.count(F.lit(1)).alias("matches"),
                    F.max("updated_at").alias("last_ingest_at"))
    t = teams.agg(F.count(F.lit(1)).alias("teams"))
    age = (F.lit(now).cast("timestamp_ntz").cast("timestamp").cast("double")
           - F.col("last_ingest_at").cast("timestamp").cast("double")) / 60.0
    # Two one-row aggregates side by side: a scalar subquery, not a pairing.
    return m.select("matches", t.select("teams").scalar().alias("teams"), "last_ingest_at",
                    F.floor(age + 0.5).cast("int").alias("age_minutes"))


def status_counts(matches: DataFrame) -> DataFrame:
    """Q2."""
    return matches.groupBy("season", "status").agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(matches: DataFrame, teams: DataFrame) -> DataFrame:
    """Q3: totals plus external ids held by more than one row."""
    dup_m = matches.groupBy("external_id").count().filter(F.col("count") > 1)
    dup_t = teams.groupBy("external_id").count().filter(F.col("count") > 1)
    return matches.agg(F.count(F.lit(1)).alias("matches")).select(
        teams.select(F.count(F.lit(1))).scalar().alias("teams"), "matches",
        dup_m.select(F.count(F.lit(1))).scalar().alias("duplicate_external_ids"),
        dup_t.select(F.count(F.lit(1))).scalar().alias("duplicate_team_external_ids"))


def _derived_club_rows(matches: DataFrame) -> DataFrame:
    """Club rows of the matches in the derivation (not cancelled), with the
    stored matchweek -- the materialised D1, refreshed after every ingest,
    which is what ``upto`` filters read and what these audits must vouch for."""
    return (matches.filter(F.col("status") != "cancelled")
            .select("id", *LEAGUE, "kicks_off_at", "matchweek",
                    F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")))


def matchweek_monotonic(matches: DataFrame) -> DataFrame:
    """Q4: a club's matchweek must never fall along its fixtures.

    Inside a slice of kickoff time the match before is a ``lag``; between slices
    it is the last match of the club's slice before, from an aggregate that keeps
    each slice's first and last matchweek. The two counts add up: no row meets
    another in a join."""
    rows = _derived_club_rows(matches).withColumn("_slice", kickoff_slice(F.col("kicks_off_at")))
    order = Window.partitionBy(*CLUB, "_slice").orderBy("kicks_off_at", "id")
    falls = lambda before: F.count_if(F.col("matchweek") < before).alias("violations")
    inside = rows.withColumn("_before", F.lag("matchweek").over(order)).groupBy(*LEAGUE).agg(falls(F.col("_before")))
    at = F.struct("kicks_off_at", "id")
    ends = rows.groupBy(*CLUB, "_slice").agg(F.min_by("matchweek", at).alias("matchweek"), F.max_by("matchweek", at).alias("_last"))
    between = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy(*CLUB).orderBy("_slice"))).groupBy(*LEAGUE).agg(
        falls(F.col("_before")))
    return inside.unionByName(between).groupBy(*LEAGUE).agg(F.sum("violations").cast("int").alias("violations"))


def matchweek_overplayed(matches: DataFrame) -> DataFrame:
    """Q5: at matchweek N no club may have played more than N games.

    Weekly counts first, with a map-side step: the c games of a week that follow b
    earlier ones are numbers b + 1 to b + c, and those above N are violations."""
    weekly = _derived_club_rows(matches).groupBy(*CLUB, "matchweek").agg(F.count(F.lit(1)).alias("c"))
    upto = running_sums(weekly, CLUB, [F.col("matchweek")], {"upto": F.col("c")}, week_slice(F.coalesce("matchweek", F.lit(-1))))
    over = F.greatest(F.lit(0), F.least(F.col("c"), F.col("upto") - F.col("matchweek")))
    return upto.groupBy(*LEAGUE).agg(F.coalesce(F.sum(F.when(F.col("matchweek").isNotNull(), over)), F.lit(0)).cast("int").alias("violations"))


def games_per_club(matches: DataFrame) -> DataFrame:
    """Q6: min / max games per club and number of clubs."""
    per_club = _derived_club_rows(matches).groupBy(*CLUB).agg(F.count(F.lit(1)).alias("games"))
    return per_club.groupBy(*LEAGUE).agg(
        F.min("games").cast("int").alias("min_games"), F.max("games").cast("int").alias("max_games"),
        F.count(F.lit(1)).cast("int").alias("clubs"))


def league_balance(matches: DataFrame) -> DataFrame:
    """Q7: goals balance, GD sums to zero, played = 2 x matches, home + away = all.

    One pass over the fan-out: per-club totals (the standings' own numbers,
    without form or position) with home and away counted conditionally, then
    summed per league-season; the match count is a second small aggregate.
    """
    cm = club_matches(matches)
    per_club = cm.groupBy(*CLUB).agg(
        F.count(F.lit(1)).alias("played"),
        F.count_if(F.col("venue") == "home").alias("home"),
        F.count_if(F.col("venue") == "away").alias("away"),
        F.sum("goals_for").alias("gf"), F.sum("goals_against").alias("ga"))
    t = per_club.groupBy(*LEAGUE).agg(
        F.count(F.lit(1)).cast("int").alias("clubs"),
        F.sum("played").cast("int").alias("sum_played"),
        F.sum("gf").cast("int").alias("sum_goals_for"),
        F.sum("ga").cast("int").alias("sum_goals_against"),
        F.sum(F.col("gf") - F.col("ga")).cast("int").alias("sum_goal_difference"),
        F.sum("home").cast("int").alias("home_played"),
        F.sum("away").cast("int").alias("away_played"))
    n = played(matches).groupBy(*LEAGUE).agg(F.count(F.lit(1)).cast("int").alias("played_matches"))
    out = t.join(n, LEAGUE, "left")
    return out.withColumn("balanced", (
        (F.col("sum_goals_for") == F.col("sum_goals_against")) & (F.col("sum_goal_difference") == 0)
        & (F.col("sum_played") == 2 * F.col("played_matches"))
        & (F.col("home_played") + F.col("away_played") == F.col("sum_played"))))


def history_shape(history: DataFrame) -> DataFrame:
    """Q9: history points vs clubs x weeks (complete when every club has
    played in week 1)."""
    return history.groupBy(*LEAGUE).agg(
        F.count(F.lit(1)).cast("int").alias("points"),
        F.countDistinct("team_id").cast("int").alias("clubs"),
        F.max("matchweek").cast("int").alias("weeks"),
    ).withColumn("expected", (F.col("clubs") * F.col("weeks")).cast("int")) \
     .withColumn("complete", F.col("points") == F.col("expected"))


def leaders(table: DataFrame, n: int = 5) -> DataFrame:
    """The top n of every table."""
    return table.filter(F.col("position") <= n).select(*LEAGUE, "position", "team_id", "short_name", "points")


def unbeaten_leaders(streak_rows: DataFrame, n: int = 5) -> DataFrame:
    """Longest current unbeaten runs, top n per league-season (the
    limit is the feature; row_number <= n is a group limit)."""
    w = Window.partitionBy(*LEAGUE).orderBy(F.col("unbeaten_streak").desc(), F.col("name").asc())
    return (streak_rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select(*LEAGUE, "rank", "team_id", "short_name", "unbeaten_streak", "win_streak"))
