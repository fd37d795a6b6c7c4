"""B18 batch form: validate a table of raw view requests in one column job.

The same rules as ``parse_view_params`` (one request), as expressions: a
season must be an integer in 2000-2100 (else the competition's latest season
with results, else 2025), ``last`` digits only and capped at 38 (0 = off),
unknown venue / opponents / sort fall back, direction is ``desc`` only when
asked for exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.operators.club import latest_season
from pitchside.plans.options import CHOICES, NUMBER, SORT_COLUMNS
from pitchside.schema import DEFAULT_SEASON, MAX_LAST_N, SEASON_MAX, SEASON_MIN


def _choice(field: str) -> Column:
    allowed, fallback = CHOICES[field]
    return F.when(F.col(f"{field}_raw").isin(*allowed), F.col(f"{field}_raw")).otherwise(F.lit(fallback))


def _numeric(raw: Column) -> Column:
    t = F.trim(raw)
    return (F.when(t == "", F.lit(0.0))
            .when(t.rlike(f"^{NUMBER}$"), t.try_cast("double")))


def validate_requests(raw: DataFrame, matches: DataFrame) -> DataFrame:
    """raw: (id, competition, season_raw, venue_raw, last_raw, opponents_raw, sort_raw, dir_raw)."""
    default = latest_season(matches).select(
        "competition", F.coalesce("season", F.lit(DEFAULT_SEASON)).alias("_default"))
    n = _numeric(F.col("season_raw"))
    season_ok = n.isNotNull() & (n == F.floor(n)) & (n >= SEASON_MIN) & (n <= SEASON_MAX)
    last = F.col("last_raw")
    last_n = F.when(last.rlike(r"^\d+$"), F.least(F.lit(float(MAX_LAST_N)), last.try_cast("double")).cast("int"))
    return (raw.join(default, "competition", "left").select(
        "id", "competition",
        F.when(season_ok, n.cast("int")).otherwise(F.coalesce("_default", F.lit(DEFAULT_SEASON))).alias("season"),
        _choice("venue").alias("venue"), F.when(last_n > 0, last_n).alias("last_n"),
        _choice("opponents").alias("opponents"), _choice("sort").alias("sort"), _choice("dir").alias("direction")))


def _pick(key: Column, values: list) -> Column:
    expr = None
    for i, v in enumerate(values):
        val = F.lit(v).cast("string")
        expr = F.when(key == i, val) if expr is None else expr.when(key == i, val)
    return expr


def requests_from_matches(matches: DataFrame) -> DataFrame:
    """One raw request per match, mixing valid and hostile values."""
    i, s = F.col("id"), F.col("season").cast("string")
    season_raw = (F.when(i % 6 == 0, s).when(i % 6 == 1, F.lit("abc")).when(i % 6 == 2, F.lit("2000"))
                  .when(i % 6 == 3, F.concat(s, F.lit(".5"))).when(i % 6 == 5, F.concat(F.lit(" 2001 "))))
    return matches.select(
        "id", "competition", season_raw.alias("season_raw"),
        _pick(i % 5, ["all", "home", "away", "HOME", None]).alias("venue_raw"),
        _pick(i % 7, ["6", "0", "45", "-3", "x", None, "12"]).alias("last_raw"),
        _pick(i % 4, ["top6", "bottom-half", "all", "top3"]).alias("opponents_raw"),
        _pick(i % 12, list(SORT_COLUMNS) + ["drop table teams", None]).alias("sort_raw"),
        _pick(i % 3, ["asc", "desc", "DESC"]).alias("dir_raw"))
