"""Fixed schemas and constants. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the reference's.
STATUSES = ("scheduled", "live", "finished", "postponed", "cancelled")
DEFAULT_COMPETITION = "eng.1"
FORM_STRIP = 5          # form shows the last five outcomes
FORM_WINDOW = 6         # the "Form (last 6)" preset
POINTS_WIN = 3
POINTS_DRAW = 1
MAX_LAST_N = 38
SEASON_MIN, SEASON_MAX = 2000, 2100
DEFAULT_SEASON = 2025

TEAMS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("external_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("short_name", T.StringType(), False),
    T.StructField("crest_url", T.StringType(), True),
    T.StructField("primary_color", T.StringType(), True),
    T.StructField("secondary_color", T.StringType(), True),
])

MATCHES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("external_id", T.StringType(), False),
    T.StructField("competition", T.StringType(), False),
    T.StructField("season", T.IntegerType(), False),
    T.StructField("matchweek", T.IntegerType(), True),
    T.StructField("kicks_off_at", T.TimestampNTZType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("home_team_id", T.LongType(), False),
    T.StructField("away_team_id", T.LongType(), False),
    T.StructField("home_goals", T.IntegerType(), True),
    T.StructField("away_goals", T.IntegerType(), True),
    T.StructField("minute", T.IntegerType(), True),
    T.StructField("stoppage_minute", T.IntegerType(), True),
    T.StructField("updated_at", T.TimestampNTZType(), False),
])

MATCH_COLUMNS = [f.name for f in MATCHES.fields]
TEAM_COLUMNS = [f.name for f in TEAMS.fields]

# Scoreboard feed: nested JSON, every field optional.
FEED_TEAM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("displayName", T.StringType()),
    T.StructField("shortDisplayName", T.StringType()),
    T.StructField("abbreviation", T.StringType()),
    T.StructField("logo", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("alternateColor", T.StringType()),
])

FEED_COMPETITOR = T.StructType([
    T.StructField("homeAway", T.StringType()),
    T.StructField("score", T.StringType()),
    T.StructField("team", FEED_TEAM),
])

FEED_EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("shortName", T.StringType()),
    T.StructField("season", T.StructType([T.StructField("year", T.IntegerType())])),
    T.StructField("status", T.StructType([
        T.StructField("displayClock", T.StringType()),
        T.StructField("type", T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("state", T.StringType()),
            T.StructField("completed", T.BooleanType()),
        ])),
    ])),
    T.StructField("competitions", T.ArrayType(T.StructType([
        T.StructField("competitors", T.ArrayType(FEED_COMPETITOR)),
    ]))),
])

SCOREBOARD = T.StructType([T.StructField("events", T.ArrayType(FEED_EVENT))])
# As it is read: a payload that does not fit keeps its text here.
CORRUPT = "_corrupt_record"
LANDED = T.StructType(SCOREBOARD.fields + [T.StructField(CORRUPT, T.StringType())])
LANDED_WITH_COMPETITION = T.StructType(LANDED.fields + [T.StructField("competition", T.StringType())])
