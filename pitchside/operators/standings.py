"""Standings family: totals (B10), points (B11), form (B12), position (B13),
display sort (B14), standings (B15), opponent presets (B16), views (B17),
points gaps (B19), home/away split (B20), final-table groups (B21).

Plan shape for one table over every league-season:
  scan -> match filters -> fan-out -> partial/final hash aggregate per club
  (+ top-5 per club for form, WindowGroupLimit before and after the shuffle)
  -> join teams (AQE picks broadcast by measured size) -> row_number per
  (competition, season) over per-club rows.
Nothing but pre-aggregated per-club rows crosses the second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.operators.club_matches import CLUB, LEAGUE, club_matches, most_recent
from pitchside.plans.options import PRESET_VIEWS, StandingsOptions, resolve_sort
from pitchside.schema import FORM_STRIP, POINTS_DRAW, POINTS_WIN
from pitchside.session import materialise


def canonical() -> list[Column]:
    """points desc, goal difference desc, goals for desc, name asc."""
    return [F.col("points").desc(), F.col("goal_difference").desc(),
            F.col("goals_for").desc(), F.col("name").asc()]


STANDINGS_COLUMNS = ["competition", "season", "position", "team_id", "name", "short_name",
                     "played", "won", "drawn", "lost", "goals_for", "goals_against",
                     "goal_difference", "points", "form", "primary_color", "secondary_color", "slug"]


def points(won: Column, drawn: Column) -> Column:
    return (won * POINTS_WIN + drawn * POINTS_DRAW).cast("int")


def total_aggs() -> list[Column]:
    o = F.col("outcome")
    return [F.count(F.lit(1)).cast("int").alias("played"),
            F.count_if(o == "W").cast("int").alias("won"),
            F.count_if(o == "D").cast("int").alias("drawn"),
            F.count_if(o == "L").cast("int").alias("lost"),
            F.coalesce(F.sum("goals_for"), F.lit(0)).cast("int").alias("goals_for"),
            F.coalesce(F.sum("goals_against"), F.lit(0)).cast("int").alias("goals_against")]


def _derived(agg: DataFrame) -> DataFrame:
    return agg.select("*", (F.col("goals_for") - F.col("goals_against")).cast("int").alias("goal_difference"),
                      points(F.col("won"), F.col("drawn")).alias("points"))


def form_agg(width: int = FORM_STRIP) -> Column:
    """B12 as a plain aggregate over rows carrying ``recency``: the i-th most
    recent outcome is max(outcome where recency = i); concat_ws skips the
    missing ones, so a club with no row in range gets ''."""
    return F.concat_ws(" ", *[F.max(F.when(F.col("recency") == i, F.col("outcome"))) for i in range(1, width + 1)])


def totals(cm: DataFrame, keys=CLUB) -> DataFrame:
    """B10/B11 per club; clubs with no surviving row are simply absent."""
    return _derived(cm.groupBy(*keys).agg(*total_aggs()))


def form_strip(recent: DataFrame, keys=CLUB, width: int = FORM_STRIP) -> DataFrame:
    """B12 from rows that carry ``recency``: last ``width`` outcomes, newest first."""
    return recent.filter(F.col("recency") <= width).groupBy(*keys).agg(form_agg(width).alias("form"))


def rank_league(df: DataFrame, order=None, keys=LEAGUE, name: str = "position") -> DataFrame:
    """Canonical row_number inside each league-season, never global."""
    w = Window.partitionBy(*keys).orderBy(*(order or canonical()))
    return df.withColumn(name, F.row_number().over(w))


def attach_teams(per_club: DataFrame, teams: DataFrame, cols=None) -> DataFrame:
    cols = cols or ["name", "short_name", "primary_color", "secondary_color", "slug"]
    t = teams.select(F.col("id").alias("team_id"), *cols)
    return per_club.join(t, "team_id")


def standings(matches: DataFrame, teams: DataFrame,
              opts: StandingsOptions = StandingsOptions()) -> DataFrame:
    """The one query behind every table view, for every league-season."""
    cm = club_matches(matches, opts)
    if opts.last_n is not None:
        # cm holds only each club's last N rows, ranked: one aggregate does all
        agg = _derived(cm.groupBy(*CLUB).agg(*total_aggs(), form_agg().alias("form")))
    else:
        # totals over every row (partial aggregation), form over the top 5
        # per club (WindowGroupLimit), joined on the club key
        agg = totals(cm).join(form_strip(most_recent(cm, FORM_STRIP)), CLUB, "left")
        agg = agg.withColumn("form", F.coalesce("form", F.lit("")))
    return rank_league(attach_teams(agg, teams)).select(STANDINGS_COLUMNS)


def display_order(table: DataFrame, sort: tuple[str, str] | None) -> DataFrame:
    """Allow-listed column + direction, ties in canonical order.

    Adds ``display_rank`` per league-season (the position is untouched).
    """
    column, ascending = resolve_sort(sort)
    first = F.col(column).asc() if ascending else F.col(column).desc()
    return rank_league(table, [first, *canonical()], name="display_rank")


def opponent_set(base: DataFrame, preset: str) -> DataFrame:
    """``top6`` / ``bottom-half`` of the unfiltered table, per league-season."""
    if preset == "top6":
        chosen = base.filter(F.col("position") <= 6)
    elif preset == "bottom-half":
        n = F.count(F.lit(1)).over(Window.partitionBy(*LEAGUE))
        chosen = base.withColumn("_n", n).filter(F.col("position") > F.ceil(F.col("_n") / 2))
    else:
        raise ValueError(preset)
    return chosen.select(*LEAGUE, "team_id")


def standings_with_preset(matches, teams, opts: StandingsOptions, preset: str,
                          base: DataFrame | None = None) -> DataFrame:
    if preset == "all":
        return standings(matches, teams, opts)
    base = base if base is not None else standings(
        matches, teams, StandingsOptions(competition=opts.competition, season=opts.season))
    # the set is needed by both clubs of a match and by totals and form alike
    members = materialise(opponent_set(base, preset), "opponents")
    return standings(matches, teams, opts.with_(opponents=members))


def standings_views(matches: DataFrame, teams: DataFrame,
                    opts: StandingsOptions = StandingsOptions()) -> DataFrame:
    """The five presets tagged with ``view`` in one job.

    Full, home and away tables and the last-N one come from one fan-out: a club
    row counts for ``full`` and for its venue; totals are one aggregate by
    (view, club), and the newest rows of each (cut to N before the shuffle)
    give both the form strips and the last-N table. Only the opponents preset
    needs a second pass, since it depends on the full table.
    """
    presets = dict(PRESET_VIEWS)
    n = presets["form"]["last_n"]
    keys = ["view", *CLUB]
    cm = club_matches(matches, opts.with_(venue="all", last_n=None))
    cm = cm.withColumn("view", F.explode(F.array(F.lit("full"), F.col("venue"))))
    newest = Window.partitionBy(*keys).orderBy(F.col("kicks_off_at").desc(), F.col("id").desc())
    recent = cm.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= max(n, FORM_STRIP))
    lastn = (recent.filter((F.col("view") == "full") & (F.col("recency") <= n)).groupBy(*CLUB)
             .agg(*total_aggs(), form_agg().alias("form")).withColumn("view", F.lit("form")))
    strips = form_strip(recent, keys)
    per_club = totals(cm, keys).join(strips, keys, "left").withColumn("form", F.coalesce("form", F.lit("")))
    tables = attach_teams(per_club.unionByName(_derived(lastn)), teams)
    # one row per club and view; the opponents preset starts from them
    tables = materialise(rank_league(tables, keys=["view", *LEAGUE]).select(*STANDINGS_COLUMNS, "view"), "views")
    base = tables.filter(F.col("view") == "full").drop("view")
    top = standings_with_preset(matches, teams, opts, presets["top6"]["opponents"], base)
    return tables.unionByName(top.withColumn("view", F.lit("top6")))


def points_gaps(table: DataFrame) -> DataFrame:
    """B19 (Cann table): one row per points value from leader to last, per
    league-season; values nobody holds keep a row with a null club."""
    # the table is small and read twice, by the spine and by the clubs on it
    table = materialise(table.select(*LEAGUE, "points", "team_id", "short_name", "played", "position"), "table")
    span = table.groupBy(*LEAGUE).agg(F.max("points").alias("hi"), F.min("points").alias("lo"))
    spine = span.select(*LEAGUE, F.explode(F.sequence("hi", "lo", F.lit(-1))).alias("points"))
    return spine.join(table, [*LEAGUE, "points"], "left")


def side_aggs() -> list[Column]:
    """Home and away records as conditional aggregates."""
    o, aggs = F.col("outcome"), []
    for side in ("home", "away"):
        on = F.col("venue") == side
        aggs += [
            F.count_if(on).cast("int").alias(f"{side}_played"),
            F.count_if(on & (o == "W")).cast("int").alias(f"{side}_won"),
            F.count_if(on & (o == "D")).cast("int").alias(f"{side}_drawn"),
            F.count_if(on & (o == "L")).cast("int").alias(f"{side}_lost"),
            F.coalesce(F.sum(F.when(on, F.col("goals_for"))), F.lit(0)).cast("int").alias(f"{side}_goals_for"),
            F.coalesce(F.sum(F.when(on, F.col("goals_against"))), F.lit(0)).cast("int").alias(f"{side}_goals_against"),
        ]
    return aggs


def side_positions(per_club: DataFrame) -> DataFrame:
    """Points and positions inside the home and the away table, over clubs with
    rows there; needs ``side_aggs`` and ``name``."""
    for side in ("home", "away"):
        per_club = per_club.withColumn(f"{side}_points", points(F.col(f"{side}_won"), F.col(f"{side}_drawn")))
        order = [F.col(f"{side}_points").desc(),
                 (F.col(f"{side}_goals_for") - F.col(f"{side}_goals_against")).desc(),
                 F.col(f"{side}_goals_for").desc(), F.col("name").asc()]
        w = Window.partitionBy(*LEAGUE).orderBy((F.col(f"{side}_played") > 0).desc(), *order)
        per_club = per_club.withColumn(f"{side}_position", F.row_number().over(w))
    return per_club


def home_away_split(matches: DataFrame, teams: DataFrame,
                    opts: StandingsOptions = StandingsOptions()) -> DataFrame:
    """Home and away records side by side, only where both exist.

    One pass: conditional aggregation by venue over the full fan-out, then the
    home and away positions inside their own tables (clubs with rows there).
    """
    cm = club_matches(matches, opts.with_(venue="all", last_n=None))
    per_club = side_positions(attach_teams(cm.groupBy(*CLUB).agg(*side_aggs()), teams, ["name"]))
    return per_club.filter((F.col("home_played") > 0) & (F.col("away_played") > 0))


def final_table_groups(table: DataFrame) -> DataFrame:
    """``top6`` and ``bottom6`` of a final table, positions not renumbered."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*LEAGUE))
    t = table.withColumn("_n", n)
    top = t.filter(F.col("position") <= 6).withColumn("group", F.lit("top6"))
    bottom = t.filter(F.col("position") > F.col("_n") - 6).withColumn("group", F.lit("bottom6"))
    return top.unionByName(bottom).select(*LEAGUE, "group", "team_id", "position")

