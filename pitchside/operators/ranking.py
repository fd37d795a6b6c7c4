"""Numbering and running totals that split a group over many tasks.

``row_number()`` or a running sum over a whole group puts the group in one
task. Here the order is cut into *slices* by a function of the row's own order
key that never falls along the order (eight weeks of kickoffs, eight
matchweeks, the first digits of a digest). Then

* a window numbers (or sums) inside a group's slice, spread by both;
* an aggregate with a map-side partial step gives each slice's count (or sum),
  and a window over these few rows what the group's earlier slices add;
* the two meet on (group, slice): one row on the second side, so rows are
  neither lost nor repeated. The pair is one struct (in which nulls equal each
  other), by which the window's rows are partitioned and sorted already: the
  join shuffles the slices alone. A hash of it stands before it: sorts compare
  numbers, and structs only where these are equal.

Which slice a row is in depends on its values alone, not on partitions, file
splits or samples, so both sides always agree, also when a lost executor makes
Spark compute one of them again. There is one path for every size, no
threshold, and no job runs while a plan is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the slices over kickoffs (days) and matchweeks.
KICKOFF_DAYS, WEEKS = 56, 8
#: First hex digits of the digest that orders new keys: 4096 slices.
DIGITS = 3
#: Group and slice as keys.
AT = ["_hash", "_at"]


def kickoff_slice(kickoff: Column) -> Column:
    """Slice number of a kickoff, rising with time."""
    return F.floor(F.datediff(kickoff.cast("date"), F.lit("1970-01-01").cast("date")) / KICKOFF_DAYS)


def week_slice(matchweek: Column) -> Column:
    return F.floor(matchweek / WEEKS)


def _at(group: list[str]) -> list[Column]:
    """Group and slice as one key, and its hash."""
    at = F.struct(*group, "_slice")
    return [F.xxhash64(at).alias("_hash"), at.alias("_at")]


def _joined(rows: DataFrame, sums: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` (with ``_at``) with the columns of its slice; null group keys meet each
    other, a row without a slice has no number."""
    return rows.join(sums.filter(F.col("_slice").isNotNull()).select(*_at(group), *[c for c in sums.columns if c not in (*group, "_slice")]), AT).drop(*AT)


def running_number(df: DataFrame, group: list[str], order: list[Column], name: str, slice_of: Column,
                   falling: bool = False) -> DataFrame:
    """``row_number() over (partition by group order by order)``.

    ``slice_of`` must not fall (``falling``: not rise) along ``order``, and not
    be null.
    """
    rows = df.withColumn("_slice", slice_of)
    inside = F.row_number().over(Window.partitionBy(*AT).orderBy(*order))
    counts = rows.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    slices = F.col("_slice").desc() if falling else F.col("_slice").asc()
    earlier = Window.partitionBy(*group).orderBy(slices).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = _joined(rows.select("*", *_at(group)).withColumn("_inside", inside), counts, group)
    return out.withColumn(name, F.col("_before") + F.col("_inside")).drop("_slice", "_inside", "_before")


def running_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column],
                 slice_of: Column) -> DataFrame:
    """``sum(col) over (partition by group order by order rows unbounded
    preceding)`` for each output column; ``slice_of`` as in ``running_number``."""
    rows = df.select("*", slice_of.alias("_slice"), *[c.alias(f"_v_{k}") for k, c in sums.items()])
    upto = Window.partitionBy(*AT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*group, "_slice").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_slice", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}")
                                               for k in sums])
    out = _joined(rows.select("*", *_at(group)).select("*", *[F.sum(f"_v_{k}").over(upto).alias(f"_i_{k}") for k in sums]), totals, group)
    return out.withColumns({k: F.col(f"_b_{k}") + F.col(f"_i_{k}") for k in sums}).drop(
        "_slice", *[f"_{p}_{k}" for k in sums for p in "vib"])


def dense_index(df: DataFrame, key: str, first: str, start: Column | int = 0, name: str = "idx") -> DataFrame:
    """Add ``name`` = start + 1, 2, ... in the order of ``first`` (rows that came
    earlier have lower numbers), then of a digest of the unique ``key``.

    The digest's first digits are the slices: equally full whatever the keys
    look like. Their counts (at most 4096 per value of ``first``) are the only
    rows that a window without a key sees.
    """
    rows = df.withColumn("_md5", F.md5(F.col(key).cast("string").cast("binary")))
    rows = rows.withColumn("_slice", F.substring("_md5", 1, DIGITS))
    inside = F.row_number().over(Window.partitionBy(*AT).orderBy("_md5", key))
    counts = rows.groupBy(first, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(first, "_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(first, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    begin = start if isinstance(start, Column) else F.lit(start)
    out = _joined(rows.select("*", *_at([first])).withColumn("_inside", inside), counts, [first])
    return out.withColumn(name, begin + F.col("_before") + F.col("_inside")).drop("_md5", "_slice", "_inside", "_before")
