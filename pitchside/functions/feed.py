"""Column functions over the scoreboard feed and dates.

All are JVM expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Feed status names -> lifecycle state.
STATUS_MAP = {
    "STATUS_SCHEDULED": "scheduled",
    "STATUS_PRE_GAME": "scheduled",
    "STATUS_DELAYED": "scheduled",
    "STATUS_IN_PROGRESS": "live",
    "STATUS_FIRST_HALF": "live",
    "STATUS_SECOND_HALF": "live",
    "STATUS_HALFTIME": "live",
    "STATUS_EXTRA_TIME": "live",
    "STATUS_SHOOTOUT": "live",
    "STATUS_FULL_TIME": "finished",
    "STATUS_FINAL": "finished",
    "STATUS_FINAL_AET": "finished",
    "STATUS_FINAL_PEN": "finished",
    "STATUS_POSTPONED": "postponed",
    "STATUS_SUSPENDED": "postponed",
    "STATUS_ABANDONED": "cancelled",
    "STATUS_CANCELED": "cancelled",
    "STATUS_CANCELLED": "cancelled",
    "STATUS_FORFEIT": "cancelled",
}
# Fixed value that must equal the reference's.
CLOCK_PATTERN = r"(\d+)\s*'?\s*(?:\+\s*(\d+))?"
HEX_PATTERN = "^[0-9a-f]{6}$"


def _status_lookup() -> Column:
    return F.create_map(*[F.lit(x) for kv in STATUS_MAP.items() for x in kv])


def normalize_status(name: Column, state: Column) -> Column:
    """Known name -> state; else ``in`` -> live, ``post`` -> finished, else scheduled."""
    fallback = F.when(state == "in", "live").when(state == "post", "finished").otherwise("scheduled")
    return F.coalesce(F.try_element_at(_status_lookup(), name), fallback)


def parse_clock(display: Column) -> tuple[Column, Column]:
    """First ``digits ['] [+digits]`` anywhere -> (minute, stoppage)."""
    minute = F.nullif(F.regexp_extract(display, CLOCK_PATTERN, 1), F.lit(""))
    stoppage = F.nullif(F.regexp_extract(display, CLOCK_PATTERN, 2), F.lit(""))
    return minute.try_cast("int"), stoppage.try_cast("int")


def parse_score(raw: Column) -> Column:
    """N4: '' / missing / junk -> null; numeric text -> int."""
    return F.nullif(F.trim(raw), F.lit("")).try_cast("int")


def normalize_hex(raw: Column) -> Column:
    """Trim, drop one leading '#', lower; must be six hex digits."""
    h = F.lower(F.regexp_replace(F.trim(raw), "^#", ""))
    return F.when(h.rlike(HEX_PATTERN), h)


def parse_kickoff(raw: Column) -> Column:
    """ISO date-time, minutes-only form included; bare dates accepted."""
    t = F.trim(raw)
    ts = F.coalesce(
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mmXXX")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd")),
    )
    # Session time zone is UTC, so the instant's wall clock is the UTC time.
    return ts.cast("timestamp_ntz")


def season_of(year: Column, kickoff: Column) -> Column:
    """Feed season year, else kickoff year (July on) or year - 1."""
    return F.coalesce(year, (F.year(kickoff) - F.when(F.month(kickoff) < 7, 1).otherwise(0)).cast("int"))


def season_window(season: Column) -> Column:
    """S3: 1 July of the year to 30 June of the next, ``YYYYMMDD-YYYYMMDD``."""
    return F.concat(season.cast("string"), F.lit("0701-"), (season + 1).cast("string"), F.lit("0630"))


def recent_window(now: Column, days_back: int = 3, days_forward: int = 10) -> Column:
    """Inclusive UTC date window around ``now``."""
    d = F.to_date(now)
    return F.concat(F.date_format(F.date_sub(d, days_back), "yyyyMMdd"), F.lit("-"),
                    F.date_format(F.date_add(d, days_forward), "yyyyMMdd"))


def season_label(season: Column) -> Column:
    """F8: 2025 -> 2025/26."""
    return F.when(season.isNotNull(),
                  F.concat(season.cast("string"), F.lit("/"), F.substring((season + 1).cast("string"), 3, 2)))
