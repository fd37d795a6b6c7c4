import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from pitchside.schema import MATCHES, TEAMS  # noqa: E402
from pitchside.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s


# Clubs, fixtures and scores of the public test league, every
# statistic of which can be computed by hand (FIXTURES.md §1).
CLUBS = ["Ashford", "Brantley", "Colwyn", "Denham", "Eastvale"]
FIXTURE = [  # home, away, home goals, away goals, kickoff, status, season
    ("Ashford", "Brantley", 1, 0, "2025-08-01 14:00", "finished", 2025),
    ("Colwyn", "Denham", 1, 0, "2025-08-01 14:00", "finished", 2025),
    ("Ashford", "Colwyn", 2, 2, "2025-08-08 14:00", "finished", 2025),
    ("Brantley", "Denham", 0, 0, "2025-08-08 14:00", "finished", 2025),
    ("Colwyn", "Denham", 3, 0, "2025-08-15 14:00", "finished", 2025),
    ("Ashford", "Brantley", None, None, "2025-08-15 14:00", "postponed", 2025),
    ("Ashford", "Colwyn", 0, 1, "2025-08-22 14:00", "finished", 2025),
    ("Brantley", "Denham", 2, 1, "2025-08-22 14:00", "finished", 2025),
    ("Eastvale", "Ashford", 2, 0, "2026-08-01 14:00", "finished", 2026),
]


def ts(text: str) -> dt.datetime:
    return dt.datetime.strptime(text, "%Y-%m-%d %H:%M")


def make_teams(spark, names=CLUBS):
    from pitchside.plans.catalog import enrich_teams

    rows = [(i + 1, f"ext-{i}-{n}", n, n, None, None, None) for i, n in enumerate(names)]
    return enrich_teams(spark.createDataFrame(rows, TEAMS))


def make_matches(spark, fixture=FIXTURE, competition="eng.1", names=CLUBS):
    from pitchside.operators.matchweek import with_matchweeks

    ids = {n: i + 1 for i, n in enumerate(names)}
    rows = [(i + 1, f"m-{i}", competition, season, None, ts(k), status, ids[h], ids[a], hg, ag, None, None, ts(k))
            for i, (h, a, hg, ag, k, status, season) in enumerate(fixture)]
    return with_matchweeks(spark.createDataFrame(rows, MATCHES))


@pytest.fixture(scope="session")
def handmade(spark):
    teams = make_teams(spark).cache()
    matches = make_matches(spark).cache()
    return teams, matches
