"""H1-H3: head-to-head records, every pair that has met, in one job.

All-pairs form: the fan-out already gives (team, opponent) rows, so one hash
aggregate keyed by (competition, team, opponent) yields every ordered pair's
record from the first club's side. Pairs that never met have no row (a zero
record by definition); nothing ever enumerates pairs of clubs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchside.operators.club_matches import fan_out, played

H2H_COLUMNS = ["competition", "team_a_id", "team_b_id", "played", "team_a_wins", "draws",
               "team_b_wins", "team_a_goals", "team_b_goals"]
MEETINGS_LIMIT = 10


def head_to_head(matches: DataFrame, competition: str | None = None) -> DataFrame:
    """H1 across all seasons, both directions."""
    m = played(matches)
    if competition is not None:
        m = m.filter(F.col("competition") == competition)
    cm = fan_out(m, ["competition"])
    gf, ga = F.col("goals_for"), F.col("goals_against")
    return (cm.groupBy("competition", F.col("team_id").alias("team_a_id"),
                       F.col("opponent_id").alias("team_b_id"))
            .agg(F.count(F.lit(1)).cast("int").alias("played"),
                 F.count_if(gf > ga).cast("int").alias("team_a_wins"),
                 F.count_if(gf == ga).cast("int").alias("draws"),
                 F.count_if(gf < ga).cast("int").alias("team_b_wins"),
                 F.coalesce(F.sum(gf), F.lit(0)).cast("int").alias("team_a_goals"),
                 F.coalesce(F.sum(ga), F.lit(0)).cast("int").alias("team_b_goals")))


def pair_record(h2h: DataFrame, pairs: DataFrame) -> DataFrame:
    """Look up requested (competition, team_a_id, team_b_id) pairs; a pair
    that never met gets the zero record."""
    out = pairs.join(h2h, ["competition", "team_a_id", "team_b_id"], "left")
    for c in H2H_COLUMNS[3:]:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return out


def meetings(matches: DataFrame, teams: DataFrame, limit: int = MEETINGS_LIMIT) -> DataFrame:
    """H2: each pair's last ``limit`` meetings, newest first (id breaks ties).

    The pair key is the unordered pair; ``row_number() <= limit`` runs as a
    WindowGroupLimit, so at most ``limit`` rows per pair leave each map task.
    """
    h, a = F.col("home_team_id"), F.col("away_team_id")
    m = played(matches).select(
        "id", "competition", "season", "kicks_off_at", "home_team_id", "away_team_id",
        "home_goals", "away_goals",
        F.least(h, a).alias("team_a_id"), F.greatest(h, a).alias("team_b_id"))
    w = Window.partitionBy("competition", "team_a_id", "team_b_id").orderBy(
        F.col("kicks_off_at").desc(), F.col("id").desc())
    top = m.withColumn("meeting", F.row_number().over(w)).filter(F.col("meeting") <= limit)
    names = teams.select("id", "short_name")
    return (top.join(names.withColumnRenamed("id", "home_team_id")
                     .withColumnRenamed("short_name", "home_name"), "home_team_id")
            .join(names.withColumnRenamed("id", "away_team_id")
                  .withColumnRenamed("short_name", "away_name"), "away_team_id")
            .select("competition", "team_a_id", "team_b_id", "meeting", "id", "season",
                    "kicks_off_at", "home_name", "away_name", "home_goals", "away_goals"))
