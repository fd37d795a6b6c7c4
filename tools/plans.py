"""Summarise the physical plan of every registered league query.

Usage: python tools/plans.py [sf_dir] [name ...]  -> markdown table on stdout.
Counts shuffles (Exchange), joins by strategy, windows, group limits and
aggregates in the plan Spark prints with ``explain("formatted")`` (the plan
before AQE re-optimisation, so joins AQE later turns into broadcasts still
show as sort-merge joins here).
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

COUNT = {
    "shuffles": r"^\(\d+\) Exchange",
    "broadcasts": r"^\(\d+\) BroadcastExchange",
    "smj": r"^\(\d+\) SortMergeJoin",
    "bhj": r"^\(\d+\) BroadcastHashJoin",
    "windows": r"^\(\d+\) Window ",
    "group_limits": r"^\(\d+\) WindowGroupLimit",
    "aggregates": r"^\(\d+\) (Hash|ObjectHash|SortAggregate)",
    "scans": r"^\(\d+\) Scan parquet",
    "python": r"^\(\d+\) (ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroupsInPandas)",
}


def summarise(df) -> dict[str, int]:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    out = {k: len(re.findall(p, text, re.M)) for k, p in COUNT.items()}
    out["pushed"] = int("PushedFilters: [" in text and "PushedFilters: []" not in text)
    return out


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    from pitchside.plans.queries import REGISTRY
    from pitchside.session import local_session

    spark = local_session(8)
    cols = list(COUNT) + ["pushed"]
    print("| query | " + " | ".join(cols) + " |")
    print("| --- | " + " | ".join("---" for _ in cols) + " |")
    for name, fn in REGISTRY.items():
        if names and name not in names:
            continue
        s = summarise(fn(spark, sf_dir))
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |", flush=True)


if __name__ == "__main__":
    main()
