"""Sliced numbering and sums give the plain window's answer: with payload
columns, a group that holds a third of all rows, ties, null group keys, several
partition counts, and after a write."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchside.operators.ranking import dense_index, kickoff_slice, running_number, running_sums, week_slice


@pytest.fixture(params=[4, 8])
def partitions(request, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(spark, n):
    group = F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 997 + 1)
    return spark.range(0, n).select(
        group.cast("int").alias("g"), "id", F.concat(F.lit("payload "), F.col("id").cast("string")).alias("payload"),
        (F.lit("2001-08-01").cast("timestamp_ntz") + F.make_interval(days=(F.col("id") * 7919 % 400).cast("int"))).alias("at"),
        (F.col("id") * 31 % 60).cast("int").alias("week"), (F.col("id") % 7 - 3).alias("v"))


@pytest.mark.parametrize("falling", [False, True])
def test_running_number(spark, partitions, tmp_path, falling):
    df = rows(spark, 300_000)
    order = [F.col("at").desc(), F.col("id").desc()] if falling else [F.col("at"), F.col("id")]
    running_number(df, ["g"], order, "rn", kickoff_slice(F.col("at")), falling).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long"))
    assert got.count() == 300_000 and got.select("id").distinct().count() == 300_000
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_running_sums(spark, partitions, tmp_path):
    df = rows(spark, 300_000)
    sums = {"s": F.col("v"), "t": F.col("v") * 2}
    running_sums(df, ["g"], [F.col("week"), F.col("id")], sums, week_slice(F.col("week"))).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    w = Window.partitionBy("g").orderBy("week", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(w).alias("s"), F.sum(F.col("v") * 2).over(w).alias("t"))
    assert got.count() == 300_000
    assert got.select(want.columns).exceptAll(want).count() == 0


@pytest.mark.parametrize("n", [0, 1, 300, 1500, 300_000])
def test_dense_index(spark, partitions, tmp_path, n):
    df = spark.range(0, n).select((F.col("id") % 2).alias("first"), F.concat(F.lit("m-"), F.col("id").cast("string")).alias("key"),
                                  (F.col("id") * 3).alias("payload"))
    dense_index(df, "key", "first", 500).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    want = df.withColumn("idx", 500 + F.row_number().over(Window.orderBy("first", F.md5(F.col("key").cast("binary")), "key")).cast("long"))
    assert got.count() == n and got.agg(F.countDistinct("idx")).first()[0] == n
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_no_job_runs_while_a_plan_is_made(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        df = rows(spark, 1000)
        running_number(df, ["g"], [F.col("at"), F.col("id")], "rn", kickoff_slice(F.col("at")))
        running_sums(df, ["g"], [F.col("week"), F.col("id")], {"s": F.col("v")}, week_slice(F.col("week")))
        dense_index(df, "id", "week")
        assert list(tracker.getJobIdsForGroup("planning")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
