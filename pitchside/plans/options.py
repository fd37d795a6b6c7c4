"""Query options (B3-B9, B14) and their validation (B18, single-request form).

Options become column predicates; an absent option is a plan without the
predicate. Sort columns go through an allow-list and never reach an
expression from user text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Any, Mapping, Sequence

from pitchside.schema import DEFAULT_SEASON, MAX_LAST_N, SEASON_MAX, SEASON_MIN

VENUES = ("all", "home", "away")
OPPONENT_SETS = ("all", "top6", "bottom-half")

# Display-sort allow-list (request name -> column).
SORT_COLUMNS = {
    "position": "position",
    "name": "name",
    "played": "played",
    "won": "won",
    "drawn": "drawn",
    "lost": "lost",
    "goalsFor": "goals_for",
    "goalsAgainst": "goals_against",
    "goalDifference": "goal_difference",
    "points": "points",
}


@dataclass(frozen=True)
class StandingsOptions:
    """Filters of the standings family.

    ``competition`` / ``season`` = None keeps every league and season (they stay
    grouping keys). ``opponents`` is either a literal list of team ids or a
    DataFrame ``(competition, season, team_id)`` giving one set per league-season;
    an empty list means no filter.
    """

    competition: str | None = None
    season: int | None = None
    upto_match: int | None = None
    venue: str = "all"
    last_n: int | None = None
    opponents: Any = None
    sort: tuple[str, str] | None = None

    def with_(self, **changes) -> "StandingsOptions":
        return replace(self, **changes)


def resolve_sort(sort: tuple[str, str] | None) -> tuple[str, bool]:
    """(column, ascending). Unknown column -> position; anything but 'asc' -> desc."""
    if sort is None:
        return "position", True
    column = SORT_COLUMNS.get(sort[0], "position")
    return column, sort[1] == "asc"


@dataclass(frozen=True)
class ViewParams:
    season: int = DEFAULT_SEASON
    venue: str = "all"
    last_n: int | None = None
    opponents: str = "all"
    sort: str = "position"
    direction: str = "asc"


#: Rules of a request, shared with the column job (``plans/views.py``): fields
#: with allowed values and what stands for any other.
CHOICES: dict[str, tuple[Sequence[str], str]] = {
    "venue": (VENUES, "all"),
    "opponents": (OPPONENT_SETS, "all"),
    "sort": (tuple(SORT_COLUMNS), "position"),
    "dir": (("asc", "desc"), "asc"),
}
#: How a season is written: decimal text; a blank counts as zero.
NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def parse_view_params(raw: Mapping[str, Any], default_season: int = DEFAULT_SEASON) -> ViewParams:
    """Untrusted request -> valid view; of a repeated field the first value
    counts, and what no rule allows falls back."""
    given = {k: (v[0] if v else None) if isinstance(v, (list, tuple)) else v for k, v in raw.items()}
    chosen = {k: given.get(k) if given.get(k) in allowed else fallback for k, (allowed, fallback) in CHOICES.items()}
    digits = str(given.get("season") if given.get("season") is not None else "x").strip()
    number = float(digits or 0) if digits == "" or re.fullmatch(NUMBER, digits) else None
    whole = number is not None and number.is_integer() and SEASON_MIN <= number <= SEASON_MAX
    last = given.get("last") or ""
    count = min(MAX_LAST_N, int(last)) if re.fullmatch(r"\d+", last) else 0
    return ViewParams(int(number) if whole else default_season, chosen["venue"], count or None, chosen["opponents"],
                      chosen["sort"], chosen["dir"])


# The one-click presets (B17), as option changes.
PRESET_VIEWS: Sequence[tuple[str, dict]] = (
    ("full", {"venue": "all", "last_n": None, "opponents": "all"}),
    ("form", {"venue": "all", "last_n": 6, "opponents": "all"}),
    ("home", {"venue": "home", "last_n": None, "opponents": "all"}),
    ("away", {"venue": "away", "last_n": None, "opponents": "all"}),
    ("top6", {"venue": "all", "last_n": None, "opponents": "top6"}),
)

__all__ = ["CHOICES", "NUMBER", "StandingsOptions", "ViewParams", "parse_view_params", "resolve_sort",
           "SORT_COLUMNS", "VENUES", "OPPONENT_SETS", "PRESET_VIEWS"]
