"""Golden values of the hand-made league (the reference's own test league)."""

from pyspark.sql import functions as F

from pitchside.operators import standings as st
from pitchside.operators.club import latest_season
from pitchside.operators.history import position_history
from pitchside.operators.matchweek import derived_matchweeks
from pitchside.plans.options import StandingsOptions


def table(teams, matches, **kw):
    opts = StandingsOptions(competition="eng.1", season=kw.pop("season", 2025), **kw)
    df = st.standings(matches, teams, opts)
    return [r.asDict() for r in df.orderBy("position").collect()]


def by_name(rows):
    return {r["name"]: r for r in rows}


def test_matchweek_counts_and_postponed(handmade):
    _, matches = handmade
    d = derived_matchweeks(matches).filter("season = 2025")
    counts = sorted((r[0], r[1]) for r in d.groupBy("matchweek").count().collect())
    assert counts == [(1, 2), (2, 2), (3, 2), (4, 2)]
    postponed = matches.filter("status = 'postponed'").first()
    assert postponed.matchweek == 3


def test_full_table(handmade):
    rows = table(*handmade)
    assert [r["name"] for r in rows] == ["Colwyn", "Ashford", "Brantley", "Denham"]
    c = rows[0]
    assert (c["position"], c["played"], c["won"], c["drawn"], c["lost"]) == (1, 4, 3, 1, 0)
    assert (c["goals_for"], c["goals_against"], c["goal_difference"], c["points"]) == (7, 2, 5, 10)
    a, b = rows[1], rows[2]
    assert a["points"] == b["points"] == 4 and a["goal_difference"] == b["goal_difference"] == 0
    assert (a["goals_for"], b["goals_for"]) == (3, 2)
    assert a["played"] == 3
    d = rows[3]
    assert (d["played"], d["won"], d["drawn"], d["lost"], d["points"]) == (4, 0, 1, 3, 1)


def test_upto(handmade):
    assert [r["name"] for r in table(*handmade, upto_match=1)] == ["Ashford", "Colwyn", "Brantley", "Denham"]
    rows = table(*handmade, upto_match=2)
    c = by_name(rows)["Colwyn"]
    assert (c["played"], c["won"], c["drawn"], c["points"]) == (2, 1, 1, 4)
    assert max(r["played"] for r in rows) <= 2


def test_balance(handmade):
    rows = table(*handmade)
    assert sum(r["goals_for"] for r in rows) == sum(r["goals_against"] for r in rows)
    assert sum(r["goal_difference"] for r in rows) == 0
    assert sum(r["played"] for r in rows) == 14


def test_promoted_club(handmade):
    rows = table(*handmade, season=2026)
    assert rows[0]["name"] == "Eastvale" and rows[0]["played"] == 1 and rows[0]["points"] == 3
    assert "Eastvale" not in by_name(table(*handmade))


def test_form_and_last_n(handmade):
    rows = by_name(table(*handmade, last_n=6))
    assert rows["Ashford"]["form"] == "L D W"
    assert rows["Colwyn"]["form"] == "W W D W"
    c = by_name(table(*handmade, last_n=2))["Colwyn"]
    assert (c["played"], c["form"], c["points"]) == (2, "W W", 6)


def test_venue(handmade):
    home = table(*handmade, venue="home")
    assert [r["name"] for r in home] == ["Colwyn", "Brantley", "Ashford"]
    c, a = home[0], home[2]
    assert (c["played"], c["won"], c["goals_for"], c["goals_against"], c["points"]) == (2, 2, 4, 0, 6)
    assert (a["played"], a["won"], a["drawn"], a["lost"], a["goals_for"], a["goals_against"], a["points"]) == \
        (3, 1, 1, 1, 3, 3, 4)
    away = table(*handmade, venue="away")
    assert [r["name"] for r in away][:3] == ["Colwyn", "Denham", "Brantley"]
    d = by_name(away)["Denham"]
    assert (d["played"], d["won"], d["drawn"], d["lost"], d["goals_for"], d["goals_against"], d["points"]) == \
        (4, 0, 1, 3, 1, 6, 1)
    total = table(*handmade)
    assert sum(r["played"] for r in home) + sum(r["played"] for r in away) == sum(r["played"] for r in total)


def test_opponents(handmade):
    rows = table(*handmade, opponents=[1, 3])
    assert [(r["name"], r["played"], r["won"], r["drawn"], r["lost"], r["points"]) for r in rows] == \
        [("Colwyn", 2, 1, 1, 0, 4), ("Ashford", 2, 0, 1, 1, 1)]
    assert [r["name"] for r in table(*handmade, opponents=[])] == ["Colwyn", "Ashford", "Brantley", "Denham"]


def _display(teams, matches, sort, **kw):
    t = st.standings(matches, teams, StandingsOptions(competition="eng.1", season=2025, **kw))
    return [(r["name"], r["position"]) for r in st.display_order(t, sort).orderBy("display_rank").collect()]


def test_display_sort(handmade):
    assert _display(*handmade, ("name", "asc")) == [("Ashford", 2), ("Brantley", 3), ("Colwyn", 1), ("Denham", 4)]
    assert [n for n, _ in _display(*handmade, ("goalsAgainst", "asc"))] == ["Colwyn", "Brantley", "Ashford", "Denham"]
    assert [n for n, _ in _display(*handmade, ("points; drop table teams", "desc"))] == \
        ["Denham", "Brantley", "Ashford", "Colwyn"]
    combined = _display(*handmade, ("points", "asc"), venue="home", last_n=2)
    assert [n for n, _ in combined] == ["Ashford", "Brantley", "Colwyn"]
    assert dict(combined)["Colwyn"] == 1


def test_latest_season(handmade, spark):
    _, matches = handmade
    assert latest_season(matches).first().season == 2026
    assert latest_season(matches.filter("competition = 'esp.1'")).count() == 0


def test_history_agrees_with_table(handmade):
    teams, matches = handmade
    hist = position_history(matches.filter("season = 2025"), teams)
    wk1 = hist.filter("matchweek = 1")
    assert wk1.count() == 4
    assert sorted(r[0] for r in hist.select("matchweek").distinct().collect()) == [1, 2, 3, 4]
    names = {r.id: r.name for r in teams.collect()}
    colwyn = [r for r in hist.collect() if names[r.team_id] == "Colwyn"]
    assert {r.matchweek: r.position for r in colwyn}[1] == 2
    last = [r for r in colwyn if r.matchweek == 4][0]
    assert (last.position, last.points) == (1, 10)
    for week in (1, 2, 3, 4):
        t = {r["team_id"]: (r["position"], r["points"]) for r in table(teams, matches, upto_match=week)}
        h = {r.team_id: (r.position, r.points) for r in hist.filter(F.col("matchweek") == week).collect()}
        assert t == h


def test_points_gaps_and_groups(handmade):
    teams, matches = handmade
    t = st.standings(matches, teams, StandingsOptions(competition="eng.1", season=2025))
    gaps = st.points_gaps(t).collect()
    assert sorted({r.points for r in gaps}) == list(range(1, 11))
    assert sum(r.team_id is not None for r in gaps) == 4
    groups = st.final_table_groups(t).collect()
    assert {r.group for r in groups} == {"top6", "bottom6"}
