"""League position of every club after every matchweek.

The reference joins each week to all earlier club-matches (a range join,
quadratic in weeks). Here one aggregate per club and slice of eight weeks sums
each of these weeks, with a map-side step; a window over a club's slices adds what
earlier ones bring; and a slice is expanded into the weeks from its first one to
the club's next match week, so that weeks without a match need no join. Then
``row_number`` per (competition, season, matchweek). Linear in rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.operators.club_matches import CLUB, LEAGUE, club_matches
from pitchside.operators.ranking import WEEKS, week_slice
from pitchside.operators.standings import canonical, points, total_aggs
from pitchside.plans.options import StandingsOptions
from pitchside.session import materialise

HISTORY_COLUMNS = ["competition", "season", "matchweek", "team_id", "position", "points", "goal_difference"]


def _week_sums(cm: DataFrame) -> DataFrame:
    """Per club and slice: ``weeks``, an array of the sums (points, goals, goal
    difference) of the slice's weeks that have a match, and ``first``, the first one."""
    week, o = F.col("matchweek"), F.col("outcome")
    aggs = []
    for i in range(WEEKS):
        here = F.pmod(week, F.lit(WEEKS)) == i
        value = {"points": points(F.count_if(here & (o == "W")), F.count_if(here & (o == "D"))),
                 "goals_for": F.sum(F.when(here, F.col("goals_for"))),
                 "goal_difference": F.sum(F.when(here, F.col("goals_for") - F.col("goals_against")))}
        aggs.append(F.when(F.count_if(here) > 0, F.struct(
            F.any_value(F.when(here, week), ignoreNulls=True).alias("week"), *[v.cast("int").alias(k) for k, v in value.items()])).alias(f"_{i}"))
    rows = cm.filter(week.isNotNull()).groupBy(*CLUB, week_slice(week).alias("slice")).agg(F.min("matchweek").alias("first"), *aggs)
    weeks = F.filter(F.array(*[F.col(f"_{i}") for i in range(WEEKS)]), lambda x: x.isNotNull())
    return rows.select(*CLUB, "slice", "first", weeks.alias("weeks"))


def _summed(weeks: Column, name: str, upto: Column | None = None) -> Column:
    some = weeks if upto is None else F.filter(weeks, lambda x: x["week"] <= upto)
    return F.aggregate(some, F.lit(0).cast("long"), lambda acc, x: acc + x[name])


def _expanded(slices: DataFrame, teams: DataFrame, last: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Slices into ranked weeks; with ``start`` (league, ``first``) only weeks from there on."""
    earlier = Window.partitionBy(*CLUB).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    names = ("points", "goals_for", "goal_difference")
    run = slices.select("*", F.lead("first").over(Window.partitionBy(*CLUB).orderBy("slice")).alias("next"),
                        *[F.coalesce(F.sum(_summed(F.col("weeks"), n)).over(earlier), F.lit(0)).alias(f"_{n}") for n in names])
    run = run.join(last, LEAGUE)
    begin, upto = F.col("first"), F.coalesce(F.col("next") - 1, F.col("last"))
    if start is not None:
        run = run.join(start.withColumnRenamed("first", "_start"), LEAGUE).filter(F.col("_start") <= upto)
        begin = F.greatest(begin, F.col("_start"))
    state = F.transform(F.sequence(begin, upto), lambda w: F.struct(
        w.alias("matchweek"), *[(F.col(f"_{n}") + _summed(F.col("weeks"), n, w)).cast("int").alias(n) for n in names]))
    named = run.select(*CLUB, F.inline(state)).join(teams.select(F.col("id").alias("team_id"), "name"), "team_id")
    w = Window.partitionBy(*LEAGUE, "matchweek").orderBy(*canonical())
    return named.withColumn("position", F.row_number().over(w)).select(HISTORY_COLUMNS)


def _last_weeks(slices: DataFrame) -> DataFrame:
    return slices.groupBy(*LEAGUE).agg(F.max(F.element_at("weeks", -1)["week"]).alias("last"))


def position_history(matches: DataFrame, teams: DataFrame,
                     opts: StandingsOptions = StandingsOptions()) -> DataFrame:
    cm = club_matches(matches, opts.with_(upto_match=None, last_n=None))
    # pre-aggregated rows that the expansion and the leagues' ends both read: written once
    slices = materialise(_week_sums(cm), "weekly")
    return _expanded(slices, teams, _last_weeks(slices))


SAID = ["matchweek", "status", "home_team_id", "away_team_id", "home_goals", "away_goals"]


def first_changed_weeks(before: DataFrame, after: DataFrame) -> DataFrame:
    """(competition, season, first): the first week whose table can differ between
    two states of the matches; leagues without a change are absent."""
    a, b = (m.select("id", F.struct(*LEAGUE, *SAID).alias(n)) for m, n in ((before, "a"), (after, "b")))
    differs = a.join(b, "id", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    return differs.select(F.inline(F.filter(F.array("a", "b"), lambda x: x.isNotNull()))).groupBy(*LEAGUE).agg(
        F.min("matchweek").alias("first"))


def refresh_history(history: DataFrame, matches: DataFrame, teams: DataFrame, changed: DataFrame) -> DataFrame:
    """P1 after an ingest: weeks before the first changed one are kept, those from
    it on are made anew, in the leagues of ``changed`` only. A league that now ends
    earlier or later than its history is taken up from that end."""
    changed = materialise(changed, "changed")
    slices = materialise(_week_sums(club_matches(matches.join(changed.select(*LEAGUE), LEAGUE, "left_semi"))), "weekly")
    last = _last_weeks(slices)
    had = history.join(changed.select(*LEAGUE), LEAGUE, "left_semi").groupBy(*LEAGUE).agg(F.max("matchweek").alias("_had"))
    start = changed.join(had, LEAGUE, "left").join(last, LEAGUE, "left").select(
        *LEAGUE, F.least("first", F.col("_had") + 1, F.col("last") + 1).alias("first")).filter(F.col("first").isNotNull())
    start = materialise(start, "start")
    kept = history.join(start, LEAGUE, "left").filter(F.col("first").isNull() | (F.col("matchweek") < F.col("first")))
    return kept.select(HISTORY_COLUMNS).unionByName(_expanded(slices, teams, last, start))


def position_at_week(matches: DataFrame, teams: DataFrame, week: int,
                     opts: StandingsOptions = StandingsOptions()) -> DataFrame:
    """P2 without the other weeks: the table of matches up to ``week``, in
    leagues that have come so far."""
    cm = club_matches(matches, opts.with_(upto_match=None, last_n=None))
    # one pass: later matches only tell how far the league has come
    cm = cm.filter(F.col("matchweek").isNotNull()).withColumn("_now", F.col("matchweek") <= week)
    counted = cm.select(*CLUB, "matchweek", *[F.when(F.col("_now"), F.col(c)).alias(c) for c in ("outcome", "goals_for", "goals_against")])
    per_club = counted.groupBy(*CLUB).agg(*total_aggs(), F.count("outcome").alias("_n"), F.max("matchweek").alias("_last"))
    per_club = per_club.select(*CLUB, "_n", "_last", "goals_for", points(F.col("won"), F.col("drawn")).alias("points"),
                               (F.col("goals_for") - F.col("goals_against")).cast("int").alias("goal_difference"))
    named = per_club.join(teams.select(F.col("id").alias("team_id"), "name"), "team_id")
    league = Window.partitionBy(*LEAGUE)
    ranked = named.withColumn("_far", F.max("_last").over(league)).withColumn(
        "position", F.row_number().over(league.orderBy((F.col("_n") == 0).asc(), *canonical())))
    return (ranked.filter((F.col("_n") > 0) & (F.col("_far") >= week)).withColumn("matchweek", F.lit(week))
            .select(HISTORY_COLUMNS))


def table_at_week(history: DataFrame, week: int, clubs: DataFrame | None = None) -> DataFrame:
    """The history slice of one week (true positions kept)."""
    t = history.filter(F.col("matchweek") == week)
    if clubs is not None:
        t = t.join(clubs.select(*CLUB), CLUB, "left_semi")
    return t


def club_line(history: DataFrame) -> DataFrame:
    """Each club's line by week, with its final position (a partial
    aggregate joined back, not a window over the club's whole line); the history
    is computed once."""
    history = materialise(history.select(*CLUB, "matchweek", "position"), "history")
    final = history.groupBy(*CLUB).agg(F.max_by("position", "matchweek").alias("final_position"))
    return history.join(final, CLUB).select(*CLUB, "matchweek", "position", "final_position")
