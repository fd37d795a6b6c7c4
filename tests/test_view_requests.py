"""The column job over a table of raw requests agrees with the
single-request validator on random, hostile input."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pitchside.plans.options import parse_view_params
from pitchside.plans.views import validate_requests
from pitchside.schema import MATCHES

TEXT = st.one_of(
    st.none(),
    st.sampled_from(["", " ", "all", "home", "away", "HOME", "top6", "bottom-half", "top3", "asc", "desc",
                     "DESC", "points", "goalsFor", "name", "drop table teams", "2025", " 2024 ", "2000.0",
                     "1999", "2101", "2025.5", "1e3", "abc", "0", "6", "38", "45", "-3", "007"]),
    st.text(alphabet="0123456789.-e ", max_size=6),
)
REQUEST = st.tuples(TEXT, TEXT, TEXT, TEXT, TEXT, TEXT)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(REQUEST, min_size=40, max_size=40))
def test_column_job_equals_single_request(spark, requests):
    kick = dt.datetime(2024, 9, 1)
    matches = spark.createDataFrame(
        [(1, "m-1", "eng.1", 2024, 1, kick, "finished", 1, 2, 1, 0, None, None, kick)], MATCHES)
    raw = spark.createDataFrame([(i, "eng.1", *r) for i, r in enumerate(requests)],
                                "id int, competition string, season_raw string, venue_raw string, last_raw string, "
                                "opponents_raw string, sort_raw string, dir_raw string")
    got = {r.id: (r.season, r.venue, r.last_n, r.opponents, r.sort, r.direction)
           for r in validate_requests(raw, matches).collect()}
    for i, (season, venue, last, opponents, sort, direction) in enumerate(requests):
        v = parse_view_params({"season": season, "venue": venue, "last": last, "opponents": opponents,
                               "sort": sort, "dir": direction}, default_season=2024)
        assert got[i] == (v.season, v.venue, v.last_n, v.opponents, v.sort, v.direction), requests[i]
