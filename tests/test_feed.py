"""Normaliser over feed samples, and the scalar feed/date functions."""

import datetime as dt
import os

from pyspark.sql import functions as F

from pitchside.functions import feed as fd
from pitchside.operators.normalize import normalize_events, split_valid
from pitchside.sources.scoreboard import read_scoreboard

DATA = os.path.join(os.path.dirname(__file__), "data", "scoreboard.json")


def _normalized(spark):
    return split_valid(normalize_events(read_scoreboard(spark, DATA, multiline=True)))


def test_normalize_samples(spark):
    good, bad = _normalized(spark)
    rows = {r.external_id: r for r in good.collect()}
    m = rows["740596"]
    assert (m.competition, m.season, m.status) == ("eng.1", 2025, "finished")
    assert (m.home.name, m.away.name, m.away.short_name) == ("Liverpool", "AFC Bournemouth", "Bournemouth")
    assert (m.home_goals, m.away_goals) == (4, 2)
    assert m.kicks_off_at == dt.datetime(2025, 8, 15, 19, 0)
    assert m.minute is None and m.stoppage_minute is None
    d = rows["740597"]
    assert (d.status, d.home_goals, d.away_goals) == ("finished", 0, 0)
    s = rows["401879301"]
    assert (s.status, s.season, s.minute, s.stoppage_minute) == ("scheduled", 2026, None, None)
    assert s.home.primary_color == "e20520"
    assert s.away.short_name == "COV"  # empty shortDisplayName falls through
    assert bad.count() == 3
    assert {r.reason for r in bad.collect()} == {"unparseable event"}


def _one(spark, expr):
    return spark.range(1).select(expr).first()


def test_clock(spark):
    cases = {"90'+7'": (90, 7), "45'+2'": (45, 2), "67'": (67, None), "0'": (0, None),
             "": (None, None), "HT": (None, None), None: (None, None)}
    for text, want in cases.items():
        m, s = fd.parse_clock(F.lit(text).cast("string"))
        assert tuple(_one(spark, [m, s])) == want, text


def test_status(spark):
    cases = [("STATUS_FULL_TIME", None, "finished"), ("STATUS_SCHEDULED", None, "scheduled"),
             ("STATUS_HALFTIME", None, "live"), ("STATUS_POSTPONED", None, "postponed"),
             ("STATUS_CANCELED", None, "cancelled"), ("STATUS_SOMETHING_NEW", "in", "live"),
             ("STATUS_SOMETHING_NEW", "post", "finished"), (None, None, "scheduled")]
    for name, state, want in cases:
        got = _one(spark, fd.normalize_status(F.lit(name).cast("string"), F.lit(state).cast("string")))[0]
        assert got == want, (name, state)


def test_windows(spark):
    cases = [("2026-08-13 04:10:36", 3, 10, "20260810-20260823"), ("2026-01-01 12:00:00", 3, 10, "20251229-20260111"),
             ("2026-03-01 00:00:00", 3, 10, "20260226-20260311"), ("2026-09-05 12:00:00", 1, 1, "20260904-20260906")]
    for now, back, fwd, want in cases:
        assert _one(spark, fd.recent_window(F.lit(now).cast("timestamp"), back, fwd))[0] == want
    assert _one(spark, fd.season_window(F.lit(2025)))[0] == "20250701-20260630"
    assert _one(spark, fd.season_label(F.lit(2025)))[0] == "2025/26"


def test_scores_and_hex(spark):
    for raw, want in [("4", 4), ("", None), (None, None), ("x", None), ("4.5", None)]:
        assert _one(spark, fd.parse_score(F.lit(raw).cast("string")))[0] == want
    for raw, want in [("#E20520", "e20520"), (" 003399 ", "003399"), ("12345", None), ("zzzzzz", None)]:
        assert _one(spark, fd.normalize_hex(F.lit(raw)))[0] == want
