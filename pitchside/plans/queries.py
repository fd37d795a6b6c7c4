"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
every competition and season of the league derived from ``sf_dir``.

Parameters that the reference binds per request are fixed here as named
constants so the Spark query and its DuckDB oracle agree.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions import colour as co
from pitchside.functions import feed as fd
from pitchside.operators import club as cl
from pitchside.operators import club_matches as cmo
from pitchside.operators import head_to_head as h2h
from pitchside.operators import history as hi
from pitchside.operators import matchweek as mw
from pitchside.operators import quality as qa
from pitchside.operators import standings as st
from pitchside.operators import normalize as nz
from pitchside.operators import streaks as sk
from pitchside.operators import upsert as up
from pitchside.plans import deliveries as dl
from pitchside.plans.catalog import league
from pitchside.plans.options import StandingsOptions
from pitchside.schema import FORM_WINDOW
from pitchside.sources import league_table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Fixed parameters of the registered queries.
UPTO_WEEK = 19
HISTORY_WEEK = 19
SORT = ("goalsAgainst", "asc")
UNKNOWN_SORT = ("drop table", "desc")
FILTER = {"competition": "lg.0", "season": 1996, "opponents": [1, 2, 3, 4, 5, 6]}
NOW_FIXTURES = dt.datetime(1998, 1, 1)
NOW_HEALTH = dt.datetime(2001, 9, 1)


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


@query
def derived_matchweeks(spark, sf_dir):
    return mw.derived_matchweeks(league(spark, sf_dir).matches)


@query
def club_matches(spark, sf_dir):
    cm = cmo.club_matches(league(spark, sf_dir).matches, recency=True)
    return cm.select("id", "competition", "season", "matchweek", "kicks_off_at", "team_id",
                     "opponent_id", "goals_for", "goals_against", "venue", "outcome",
                     F.col("recency").cast("int").alias("recency"))


def _standings(spark, sf_dir, **opts):
    lg = league(spark, sf_dir)
    return st.standings(lg.matches, lg.teams, StandingsOptions(**opts))


@query
def standings(spark, sf_dir):
    return _standings(spark, sf_dir)


# ---- standings family (B5-B21) -------------------------------------------

@query
def standings_upto(spark, sf_dir):
    return _standings(spark, sf_dir, upto_match=UPTO_WEEK)


@query
def standings_home(spark, sf_dir):
    return _standings(spark, sf_dir, venue="home")


@query
def standings_away(spark, sf_dir):
    return _standings(spark, sf_dir, venue="away")


@query
def standings_last6(spark, sf_dir):
    return _standings(spark, sf_dir, last_n=FORM_WINDOW)


@query
def standings_top6(spark, sf_dir):
    lg = league(spark, sf_dir)
    return st.standings_with_preset(lg.matches, lg.teams, StandingsOptions(), "top6")


@query
def standings_bottom_half(spark, sf_dir):
    lg = league(spark, sf_dir)
    return st.standings_with_preset(lg.matches, lg.teams, StandingsOptions(), "bottom-half")


@query
def standings_sorted(spark, sf_dir):
    return st.display_order(_standings(spark, sf_dir), SORT)


@query
def standings_sorted_unknown(spark, sf_dir):
    return st.display_order(_standings(spark, sf_dir), UNKNOWN_SORT)


@query
def standings_filtered(spark, sf_dir):
    return _standings(spark, sf_dir, **FILTER)


@query
def standings_views(spark, sf_dir):
    lg = league(spark, sf_dir)
    return st.standings_views(lg.matches, lg.teams)


@query
def points_gaps(spark, sf_dir):
    return st.points_gaps(_standings(spark, sf_dir))


@query
def home_away_split(spark, sf_dir):
    lg = league(spark, sf_dir)
    return st.home_away_split(lg.matches, lg.teams)


@query
def history_groups(spark, sf_dir):
    lg = league(spark, sf_dir)
    groups = st.final_table_groups(st.standings(lg.matches, lg.teams))
    hist = hi.position_history(lg.matches, lg.teams)
    return hist.join(groups.select("competition", "season", "group", "team_id"),
                     ["competition", "season", "team_id"]).select(
        "competition", "season", "group", "matchweek", "team_id", "position", "points")


# ---- streaks, head-to-head, history (T1, H1-H3, P1-P3, L1) ----------------

@query
def streaks(spark, sf_dir):
    lg = league(spark, sf_dir)
    return sk.streaks(lg.matches, lg.teams)


@query
def streaks_home(spark, sf_dir):
    lg = league(spark, sf_dir)
    return sk.streaks(lg.matches, lg.teams, StandingsOptions(venue="home"))


@query
def head_to_head(spark, sf_dir):
    return h2h.head_to_head(league(spark, sf_dir).matches)


@query
def meetings(spark, sf_dir):
    lg = league(spark, sf_dir)
    return h2h.meetings(lg.matches, lg.teams)


@query
def position_history(spark, sf_dir):
    lg = league(spark, sf_dir)
    return hi.position_history(lg.matches, lg.teams)


@query
def table_at_week(spark, sf_dir):
    lg = league(spark, sf_dir)
    return hi.position_at_week(lg.matches, lg.teams, HISTORY_WEEK)


@query
def club_line(spark, sf_dir):
    return hi.club_line(position_history(spark, sf_dir))


@query
def latest_season(spark, sf_dir):
    return cl.latest_season(league(spark, sf_dir).matches)


# ---- clubs (C1-C5) and colours (F1-F8) -------------------------------------

@query
def club_fixtures(spark, sf_dir):
    lg = league(spark, sf_dir)
    return cl.club_fixtures(lg.matches, lg.teams)


@query
def results_list(spark, sf_dir):
    return cl.results_list(club_fixtures(spark, sf_dir))


@query
def next_fixture(spark, sf_dir):
    lg = league(spark, sf_dir)
    return cl.next_fixture(lg.matches, lg.teams, NOW_FIXTURES)


@query
def club_profile(spark, sf_dir):
    lg = league(spark, sf_dir)
    return cl.club_profile(lg.matches, lg.teams, NOW_FIXTURES)


@query
def slugs(spark, sf_dir):
    return cl.slugs(league(spark, sf_dir).teams)


@query
def club_colours(spark, sf_dir):
    out = co.club_colour_pair(league(spark, sf_dir).teams.select("id", "name", "primary_color", "secondary_color"))
    return out.select(
        "id", "name",
        F.col("light.hex").alias("light_hex"), F.col("light.source").alias("light_source"),
        F.round("light.contrast", 6).alias("light_contrast"),
        F.col("dark.hex").alias("dark_hex"), F.col("dark.source").alias("dark_source"),
        F.round("dark.contrast", 6).alias("dark_contrast"),
        "css_light", "css_dark")


@query
def color_audit(spark, sf_dir):
    c = club_colours(spark, sf_dir)
    rows = c.select(F.inline(F.array(
        F.struct(F.lit("light").alias("ground"), F.col("light_contrast").alias("ratio")),
        F.struct(F.lit("dark").alias("ground"), F.col("dark_contrast").alias("ratio")))))
    return rows.groupBy("ground").agg(
        F.count(F.lit(1)).cast("int").alias("clubs"),
        F.count_if(F.col("ratio") < co.MIN_CONTRAST).cast("int").alias("below_threshold"),
        F.min("ratio").alias("worst_ratio"))


@query
def feed_windows(spark, sf_dir):
    m = league(spark, sf_dir).matches
    return m.select("id", fd.recent_window(F.col("kicks_off_at")).alias("recent_window"),
                    fd.season_window(F.col("season")).alias("season_window"),
                    fd.season_label(F.col("season")).alias("season_label"))


# ---- quality and audit (Q1-Q10) ---------------------------------------------

@query
def feed_health(spark, sf_dir):
    lg = league(spark, sf_dir)
    return qa.feed_health(lg.matches, lg.teams, NOW_HEALTH)


@query
def status_counts(spark, sf_dir):
    return qa.status_counts(league(spark, sf_dir).matches)


@query
def duplicate_keys(spark, sf_dir):
    lg = league(spark, sf_dir)
    return qa.duplicate_keys(lg.matches, lg.teams)


@query
def matchweek_monotonic(spark, sf_dir):
    return qa.matchweek_monotonic(league(spark, sf_dir).matches)


@query
def matchweek_overplayed(spark, sf_dir):
    return qa.matchweek_overplayed(league(spark, sf_dir).matches)


@query
def games_per_club(spark, sf_dir):
    return qa.games_per_club(league(spark, sf_dir).matches)


@query
def league_balance(spark, sf_dir):
    return qa.league_balance(league(spark, sf_dir).matches)


@query
def history_shape(spark, sf_dir):
    return qa.history_shape(position_history(spark, sf_dir))


@query
def leaders(spark, sf_dir):
    return qa.leaders(_standings(spark, sf_dir))


@query
def unbeaten_leaders(spark, sf_dir):
    return qa.unbeaten_leaders(streaks(spark, sf_dir))


# ---- feed, normalisation, upsert (S1-S7, N1-N10, U1-U7) -----------------------

def _normalized(spark, sf_dir):
    return nz.normalize_events(dl.feed_events(spark, sf_dir))


@query
def normalize_events(spark, sf_dir):
    good, _ = nz.split_valid(_normalized(spark, sf_dir))
    return good.select(
        "external_id", "competition", "season", "kicks_off_at", "status",
        F.col("home.external_id").alias("home_external_id"), F.col("home.name").alias("home_name"),
        F.col("home.short_name").alias("home_short_name"),
        F.col("home.primary_color").alias("home_primary_color"),
        F.col("away.external_id").alias("away_external_id"),
        F.col("away.secondary_color").alias("away_secondary_color"),
        "home_goals", "away_goals", "minute", "stoppage_minute")


@query
def quarantine(spark, sf_dir):
    _, bad = nz.split_valid(_normalized(spark, sf_dir))
    return bad.select("external_id", "reason")


def _ingest(spark, sf_dir):
    return dl.batch_ingest(spark, sf_dir)


@query
def upsert_teams(spark, sf_dir):
    return _ingest(spark, sf_dir).teams


@query
def upsert_matches(spark, sf_dir):
    return _ingest(spark, sf_dir).upserted


@query
def refresh_matchweeks(spark, sf_dir):
    return _ingest(spark, sf_dir).changes.select(
        "id", "competition", "season", F.col("old").alias("old_matchweek"), F.col("new").alias("new_matchweek"))


@query
def ingest_report(spark, sf_dir):
    return _ingest(spark, sf_dir).report.unionByName(dl.window_ingest(spark, sf_dir).report)


@query
def ingest_window(spark, sf_dir):
    return dl.window_ingest(spark, sf_dir).matches


@query
def ingest_quarantine(spark, sf_dir):
    return dl.window_ingest(spark, sf_dir).quarantine.select("external_id", "reason")


@query
def ingest_stream(spark, sf_dir):
    _, matches = dl.stream_ingest(spark, sf_dir)
    return matches


@query
def history_after_ingest(spark, sf_dir):
    """P1 maintained over the window ingest: only weeks that it changed are made anew."""
    d, res = dl.landed(spark, sf_dir), dl.window_ingest(spark, sf_dir)
    before = hi.position_history(d.stored_matches, d.stored_teams)
    scope = up.in_partitions(res.matches, res.partitions, dl.BUCKETS)
    changed = hi.first_changed_weeks(d.stored_matches.filter(scope), res.matches.filter(scope))
    return hi.refresh_history(before, res.matches, res.teams, changed)


@query
def ingest_season(spark, sf_dir):
    return dl.season_ingest(spark, sf_dir).matches


@query
def ingest_recent(spark, sf_dir):
    return league_table.tables(spark, dl.polled(spark, sf_dir))[1]


@query
def poll_windows(spark, sf_dir):
    return up.ingest_runs(spark, dl.polled(spark, sf_dir)).select(
        "window", "fetched", "teams_upserted", "matches_upserted", "skipped")


@query
def feed_corrupt(spark, sf_dir):
    """What of a damaged feed goes to the quarantine, by payload."""
    _, bad = nz.split_valid(nz.normalize_events(dl.corrupt_events(spark, sf_dir)))
    return bad.select(F.regexp_extract("arrival.file", "competition=([^/]*)", 1).alias("competition"), "reason",
                      F.nullif(F.regexp_extract(F.coalesce("record", F.lit("")), "m-[0-9]+", 0), F.lit("")).alias("first_event"))


@query
def club_lookup(spark, sf_dir):
    """Requested slugs (every club's, and some that no club has) to clubs."""
    teams = league(spark, sf_dir).teams
    asked = teams.select(F.col("id").alias("request"), F.when(F.col("id") % 3 == 1, F.concat(F.lit("no-"), "slug")).otherwise(F.col("slug")).alias("slug"))
    return cl.find_clubs(teams, asked)


@query
def pair_records(spark, sf_dir):
    """H3: each club against the next two by id, met or not."""
    lg = league(spark, sf_dir)
    pairs = lg.matches.select("competition", F.explode(F.array("home_team_id", "away_team_id")).alias("team_a_id")).distinct()
    pairs = pairs.select("competition", "team_a_id", F.explode(F.array(F.col("team_a_id") + 1, F.col("team_a_id") + 2)).alias("team_b_id"))
    return h2h.pair_record(h2h.head_to_head(lg.matches), pairs)


@query
def view_requests(spark, sf_dir):
    from pitchside.plans import views

    m = league(spark, sf_dir).matches
    return views.validate_requests(views.requests_from_matches(m), m)
