"""Edge cases the reference leaves untested (FIXTURES.md §1, last paragraph)."""

import datetime as dt

from pyspark.sql import functions as F

from pitchside.operators.club import find_club, latest_season, next_fixture, slugs
from pitchside.operators.standings import standings
from pitchside.plans.options import StandingsOptions
from tests.conftest import make_matches, make_teams

CLUBS = ["Ashford", "Brantley", "Colwyn"]


def test_finished_without_score(spark):
    fixture = [("Ashford", "Brantley", 1, None, "2030-08-01 14:00", "finished", 2030)]
    teams, matches = make_teams(spark, CLUBS), make_matches(spark, fixture, names=CLUBS)
    # latest season needs only a finished status; the table needs scores
    assert latest_season(matches).first().season == 2030
    assert standings(matches, teams, StandingsOptions(season=2030)).count() == 0


def test_null_matchweek_only_drops_out_under_upto(spark, handmade):
    teams, matches = handmade
    blanked = matches.withColumn("matchweek", F.when(F.col("id") == 1, None).otherwise(F.col("matchweek")))
    full = {r.name: r.played for r in standings(blanked, teams, StandingsOptions(season=2025)).collect()}
    upto = {r.name: r.played for r in standings(blanked, teams, StandingsOptions(season=2025, upto_match=4)).collect()}
    assert full["Ashford"] == 3 and upto["Ashford"] == 2
    assert full["Brantley"] == 3 and upto["Brantley"] == 2


def test_next_fixture_any_season_with_id_tiebreak(spark):
    fixture = [("Ashford", "Brantley", None, None, "2030-08-10 14:00", "scheduled", 2030),
               ("Colwyn", "Ashford", None, None, "2030-08-10 14:00", "live", 2030),
               ("Ashford", "Colwyn", None, None, "2030-08-05 14:00", "postponed", 2030),
               ("Brantley", "Colwyn", None, None, "2031-08-01 14:00", "scheduled", 2031)]
    teams, matches = make_teams(spark, CLUBS), make_matches(spark, fixture, names=CLUBS)
    nxt = {r.team_id: r for r in next_fixture(matches, teams, dt.datetime(2030, 8, 1)).collect()}
    assert (nxt[1].id, nxt[1].venue, nxt[1].opponent_name) == (1, "home", "Brantley")  # id breaks the tie
    assert (nxt[3].id, nxt[3].venue) == (2, "home")
    assert nxt[2].id == 1
    later = {r.team_id: r.id for r in next_fixture(matches, teams, dt.datetime(2030, 9, 1)).collect()}
    assert later == {2: 4, 3: 4}                                                  # another season


def test_slug_lookup_and_collisions(spark):
    teams = make_teams(spark, ["Atlético Madrid", "Atletico Madrid", "Brighton & Hove Albion"])
    s = {r.id: r for r in slugs(teams).collect()}
    assert s[1].slug == s[2].slug == "atletico-madrid" and s[1].slug_collisions == 2
    assert s[1].owns_slug and not s[2].owns_slug
    assert [r.id for r in find_club(teams, "atletico-madrid").collect()] == [1]
    assert [r.name for r in find_club(teams, "brighton-and-hove-albion").collect()] == ["Brighton & Hove Albion"]
    assert find_club(teams, "nowhere").count() == 0
