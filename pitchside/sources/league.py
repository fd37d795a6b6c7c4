"""The league derived from the driver's tables, plus the two table scans.

Clubs come from ``supplier``, fixtures from ``orders``. Leagues hold 20 clubs,
so the data grows by more leagues, as it does in reality. The derivation is a
pure projection of ``orders`` with one scalar (the number of clubs), so it
scales linearly and needs no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.schema import MATCH_COLUMNS, TEAM_COLUMNS

LEAGUE_SIZE = 20

# Fixed values of the derived league (FIXTURES.md §4).
NAME_PREFIXES = ["Atlético ", "A.F.C. Port ", "Brook & Vale ", "Sporting (West) ", "Beşiktaş "]
PRIMARY_FIXED = {0: "ffffff", 1: "000000", 2: "ffcd00", 3: None}
SECONDARY_FIXED = {0: "000000", 1: "ffffff", 2: None}
PRIMARY_MULTIPLIER = 245489
SECONDARY_MULTIPLIER = 77773


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hex6(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x % F.lit(16777216)), 6, "0"))


def _case(key: Column, mapping: dict, otherwise: Column) -> Column:
    expr = None
    for k, v in mapping.items():
        val = F.lit(v).cast("string")
        expr = F.when(key == k, val) if expr is None else expr.when(key == k, val)
    return expr.otherwise(otherwise)


def derive_teams(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    prefix = _case(k % 5, dict(enumerate(NAME_PREFIXES[:4])), F.lit(NAME_PREFIXES[4]))
    return supplier.select(
        (k + 1).cast("long").alias("id"),
        F.concat(F.lit("ext-"), k.cast("string")).alias("external_id"),
        F.concat(prefix, k.cast("string")).alias("name"),
        F.concat(F.lit("S"), k.cast("string")).alias("short_name"),
        F.lit(None).cast("string").alias("crest_url"),
        _case(k % 7, PRIMARY_FIXED, _hex6(k * PRIMARY_MULTIPLIER)).alias("primary_color"),
        _case(k % 4, SECONDARY_FIXED, _hex6(k * SECONDARY_MULTIPLIER)).alias("secondary_color"),
    )


def derive_matches(orders: DataFrame, supplier: DataFrame) -> DataFrame:
    """Fixtures without ``matchweek`` (added by ``derived_matchweeks``)."""
    n_clubs = supplier.select(F.count(F.lit(1))).scalar()  # scalar subquery, not a join
    key = F.col("o_orderkey")
    h = key % n_clubs
    season = (F.year("o_orderdate") - F.when(F.month("o_orderdate") < 7, 1).otherwise(0)).cast("int")
    base = orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority",
        h.alias("h"), season.alias("season"),
        (F.floor("o_totalprice").cast("bigint") % 5).cast("int").alias("hg"),
        (F.floor(F.col("o_totalprice") / 10).cast("bigint") % 4).cast("int").alias("ag"),
    ).withColumn("l", F.least(F.lit(LEAGUE_SIZE).cast("bigint"), n_clubs - (F.col("h") - F.col("h") % LEAGUE_SIZE)))
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    status = (
        F.when(F.col("season") >= 2001, "scheduled")
        .when((st == "O") & (pr == "5-LOW"), "scheduled")
        .when((st == "P") & (pr == "1-URGENT"), "postponed")
        .when((st == "P") & (pr == "2-HIGH"), "cancelled")
        .when((st == "P") & (pr == "3-MEDIUM"), "live")
        .otherwise("finished")
    )
    base = base.withColumn("status", status)
    k, hh, l, s = F.col("o_orderkey"), F.col("h"), F.col("l"), F.col("status")
    played = s.isin("finished", "live")
    scheduled_nil = (s == "scheduled") & (k % 7 == 0)
    return base.select(
        (k + 1).cast("long").alias("id"),
        F.concat(F.lit("m-"), k.cast("string")).alias("external_id"),
        F.concat(F.lit("lg."), F.floor(hh / LEAGUE_SIZE).cast("int").cast("string")).alias("competition"),
        "season",
        F.lit(None).cast("int").alias("matchweek"),
        F.col("o_orderdate").alias("kicks_off_at"),
        "status",
        (hh + 1).cast("long").alias("home_team_id"),
        ((hh - hh % LEAGUE_SIZE) + (hh % LEAGUE_SIZE + 1 + F.col("o_custkey") % (l - 1)) % l + 1)
        .cast("long").alias("away_team_id"),
        F.when(played, F.col("hg")).when(scheduled_nil, F.lit(0)).alias("home_goals"),
        F.when((s == "finished") & (k % 97 == 0), F.lit(None).cast("int"))
        .when(played, F.col("ag")).when(scheduled_nil, F.lit(0)).alias("away_goals"),
        F.when(s == "live", (k % 90 + 1).cast("int")).alias("minute"),
        F.when((s == "live") & (k % 45 == 44), (k % 8 + 1).cast("int")).alias("stoppage_minute"),
        F.col("o_orderdate").alias("updated_at"),
    ).select(MATCH_COLUMNS)


def raw_league(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(teams, matches-without-matchweek) straight from the driver tables."""
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return derive_teams(supplier).select(TEAM_COLUMNS), derive_matches(orders, supplier)
