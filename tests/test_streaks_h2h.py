from pitchside.operators.club import club_fixtures, next_fixture, results_list
from pitchside.operators.head_to_head import head_to_head, meetings
from pitchside.operators.streaks import streaks
from pitchside.plans.options import StandingsOptions
import datetime as dt


def test_streaks(handmade):
    teams, matches = handmade
    rows = {r.name: r for r in streaks(matches, teams, StandingsOptions(season=2025)).collect()}
    b, c, d, a = rows["Brantley"], rows["Colwyn"], rows["Denham"], rows["Ashford"]
    assert (b.win_streak, b.unbeaten_streak, b.winless_streak) == (1, 2, 0)
    assert (c.win_streak, c.unbeaten_streak, c.clean_sheet_streak) == (2, 4, 2)
    assert (d.win_streak, d.unbeaten_streak, d.winless_streak) == (0, 0, 4)
    assert (a.win_streak, a.unbeaten_streak, a.winless_streak) == (0, 0, 2)


def test_head_to_head(handmade):
    teams, matches = handmade
    h = {(r.team_a_id, r.team_b_id): r for r in head_to_head(matches, "eng.1").collect()}
    ac = h[(1, 3)]
    assert (ac.played, ac.team_a_wins, ac.draws, ac.team_b_wins, ac.team_a_goals, ac.team_b_goals) == (2, 0, 1, 1, 2, 3)
    assert (5, 4) not in h  # Eastvale and Denham never met: no row, a zero record
    m = [r for r in meetings(matches, teams).collect() if (r.team_a_id, r.team_b_id) == (1, 2)]
    assert len(m) == 1 and m[0].home_goals == 1


def test_club_fixtures_and_next(handmade):
    teams, matches = handmade
    fx = club_fixtures(matches, teams, "eng.1", 2025).filter("team_id = 1").orderBy("kicks_off_at", "id").collect()
    assert len(fx) == 4
    assert [f.outcome for f in fx] == ["W", "D", None, "L"]
    assert results_list(club_fixtures(matches, teams)).filter("team_id = 1").count() == 4
    nxt = next_fixture(matches, teams, dt.datetime(2025, 8, 10)).collect()
    assert nxt == []  # only the postponed fixture lies ahead, and it is excluded
