"""Spark results against plain-Python brute force on a random league with
tied kickoffs, postponed / cancelled / scheduled matches and missing scores."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from pitchside.operators.history import position_history
from pitchside.operators.matchweek import with_matchweeks
from pitchside.operators.standings import standings
from pitchside.operators.streaks import streaks
from pitchside.plans.catalog import enrich_teams
from pitchside.plans.options import StandingsOptions
from pitchside.schema import MATCHES, TEAMS


def make_league(seed=7):
    rnd = random.Random(seed)
    teams, matches = [], []
    tid = mid = 0
    for c in range(3):
        clubs = []
        for _ in range(6):
            tid += 1
            clubs.append(tid)
            teams.append((tid, f"ext-{tid}", f"Club {rnd.choice('ABC')}{tid:03d}", f"C{tid}", None, None, None))
        for season in (2024, 2025):
            for _ in range(40):
                mid += 1
                h, a = rnd.sample(clubs, 2)
                kick = dt.datetime(season, 8, 1) + dt.timedelta(days=rnd.randint(0, 30) * 3)
                status = rnd.choices(["finished", "postponed", "cancelled", "scheduled"], [80, 8, 6, 6])[0]
                hg = ag = None
                if status == "finished":
                    hg, ag = rnd.randint(0, 3), rnd.randint(0, 3)
                    if rnd.random() < 0.05:
                        ag = None
                matches.append((mid, f"m-{mid}", f"c{c}", season, None, kick, status, h, a, hg, ag, None, None, kick))
    return teams, matches


def brute(teams, matches):
    name = {t[0]: t[2] for t in teams}
    # matchweek
    seq = defaultdict(list)
    for m in matches:
        if m[6] != "cancelled":
            for t in (m[7], m[8]):
                seq[(m[2], m[3], t)].append((m[5], m[0]))
    nth = {}
    for k, rows in seq.items():
        for i, (_, mid) in enumerate(sorted(rows), 1):
            nth[(mid, k[2])] = i
    mw = {m[0]: max(nth[(m[0], m[7])], nth[(m[0], m[8])]) for m in matches if m[6] != "cancelled"}
    # club rows of played matches
    rows = defaultdict(list)
    for m in matches:
        if m[6] == "finished" and m[9] is not None and m[10] is not None:
            for t, gf, ga in ((m[7], m[9], m[10]), (m[8], m[10], m[9])):
                rows[(m[2], m[3], t)].append((m[5], m[0], gf, ga, mw[m[0]]))

    def outcome(gf, ga):
        return "W" if gf > ga else "D" if gf == ga else "L"

    table, streak = {}, {}
    for k, rs in rows.items():
        rs = sorted(rs, reverse=True)                       # recency order
        oc = [outcome(gf, ga) for _, _, gf, ga, _ in rs]
        w, d = oc.count("W"), oc.count("D")
        gf, ga = sum(r[2] for r in rs), sum(r[3] for r in rs)
        table[k] = dict(played=len(rs), won=w, drawn=d, lost=oc.count("L"), goals_for=gf, goals_against=ga,
                        goal_difference=gf - ga, points=3 * w + d, form=" ".join(oc[:5]))

        def run(breaks):
            return next((i for i, r in enumerate(rs) if breaks(r)), len(rs))
        streak[k] = (run(lambda r: outcome(r[2], r[3]) != "W"), run(lambda r: outcome(r[2], r[3]) == "L"),
                     run(lambda r: outcome(r[2], r[3]) == "W"), run(lambda r: r[3] != 0))
    for lg in {k[:2] for k in table}:
        clubs = sorted((k for k in table if k[:2] == lg),
                       key=lambda k: (-table[k]["points"], -table[k]["goal_difference"], -table[k]["goals_for"],
                                      name[k[2]]))
        for pos, k in enumerate(clubs, 1):
            table[k]["position"] = pos
    # position history
    hist = {}
    for lg in {k[:2] for k in rows}:
        last = max(r[4] for k, rs in rows.items() if k[:2] == lg for r in rs)
        for week in range(1, last + 1):
            cum = {}
            for k, rs in rows.items():
                if k[:2] != lg:
                    continue
                sel = [r for r in rs if r[4] <= week]
                if sel:
                    w = sum(outcome(r[2], r[3]) == "W" for r in sel)
                    d = sum(outcome(r[2], r[3]) == "D" for r in sel)
                    gf, ga = sum(r[2] for r in sel), sum(r[3] for r in sel)
                    cum[k] = (3 * w + d, gf - ga, gf)
            order = sorted(cum, key=lambda k: (-cum[k][0], -cum[k][1], -cum[k][2], name[k[2]]))
            for pos, k in enumerate(order, 1):
                hist[(*k, week)] = (pos, cum[k][0], cum[k][1])
    return mw, table, streak, hist


@pytest.fixture(scope="module")
def league(spark):
    teams, matches = make_league()
    t = enrich_teams(spark.createDataFrame(teams, TEAMS)).cache()
    m = with_matchweeks(spark.createDataFrame(matches, MATCHES)).cache()
    return t, m, brute(teams, matches)


def test_matchweeks(league):
    _, m, (mw, _, _, _) = league
    got = {r.id: r.matchweek for r in m.filter("status <> 'cancelled'").collect()}
    assert got == mw


def test_standings(league):
    t, m, (_, table, _, _) = league
    got = {(r.competition, r.season, r.team_id): {k: r[k] for k in ("played", "won", "drawn", "lost", "goals_for",
                                                                   "goals_against", "goal_difference", "points",
                                                                   "form", "position")}
           for r in standings(m, t).collect()}
    assert got == table


def test_streaks(league):
    t, m, (_, _, streak, _) = league
    got = {(r.competition, r.season, r.team_id): (r.win_streak, r.unbeaten_streak, r.winless_streak,
                                                  r.clean_sheet_streak)
           for r in streaks(m, t, StandingsOptions()).collect()}
    assert got == streak


def test_position_history(league):
    t, m, (_, _, _, hist) = league
    got = {(r.competition, r.season, r.team_id, r.matchweek): (r.position, r.points, r.goal_difference)
           for r in position_history(m, t).collect()}
    assert got == hist


@pytest.mark.parametrize("seed", [1, 2])
def test_history_is_maintained(spark, seed):
    """After results, cancellations, moves and new matches the maintained history
    equals the whole one, delivery after delivery."""
    from pyspark.sql import functions as F

    from pitchside.operators.history import first_changed_weeks, refresh_history

    teams, rows = make_league(seed)
    rnd = random.Random(seed)
    t = enrich_teams(spark.createDataFrame(teams, TEAMS))
    frame = lambda r: with_matchweeks(spark.createDataFrame(r, MATCHES)).cache()
    state = frame(rows)
    history = position_history(state, t).cache()
    for step in range(3):
        new = []
        for m in rows:
            m = list(m)
            late = m[5] > dt.datetime(m[3], 9, 20)
            if rnd.random() < (0.05 if step == 0 else 0.02) and (late or step):
                kind = rnd.choice(["score", "off", "on", "moved", "league"])
                if kind == "score":
                    m[6], m[9], m[10] = "finished", rnd.randint(0, 3), rnd.randint(0, 3)
                elif kind == "off":
                    m[6], m[9], m[10] = rnd.choice(["postponed", "cancelled"]), None, None
                elif kind == "on":
                    m[6], m[9], m[10] = "finished", 2, 1
                elif kind == "moved":
                    m[5] += dt.timedelta(days=9)
                else:
                    m[3] = 2049 - m[3]
            new.append(tuple(m))
        if step == 1:                       # the end of a league is taken away
            new = [m for m in new if not (m[2] == "c0" and m[5] > dt.datetime(m[3], 9, 25))]
        if step == 2:
            new += [(10_000 + i, f"n-{i}", "c1", 2024, None, dt.datetime(2024, 12, 1) + dt.timedelta(days=i), "finished", 7 + i % 3, 10 + i % 3,
                     i % 3, 1, None, None, dt.datetime(2024, 12, 1)) for i in range(9)]
        after = frame(new)
        changed = first_changed_weeks(state, after)
        got = refresh_history(history, after, t, changed)
        want = position_history(after, t)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        firsts = {(r.competition, r.season): r["first"] for r in changed.collect()}
        assert step or any(f is not None and f > 3 for f in firsts.values())     # early weeks were left alone
        rows, state, history = new, after, want.cache()
