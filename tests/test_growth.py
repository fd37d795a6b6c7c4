"""What has to stay narrow as the tables grow: landed feeds, the sliced numbering, the clubs of a feed."""

import os

from pyspark.sql import functions as F

from pitchside.operators.ranking import kickoff_slice, running_number
from pitchside.operators.upsert import incoming_teams
from pitchside.sources.scoreboard import FEED_ORDER, land_by_week, land_delivery, read_scoreboard, render_events, write_delivery


def _files(path, end):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(end)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_landed_feeds_are_compressed_and_the_same(spark, handmade, tmp_path):
    teams, matches = handmade
    land_delivery(matches, teams, f"{tmp_path}/a", 1)
    write_delivery(render_events(matches, teams), f"{tmp_path}/b", 1)
    land_by_week(matches, teams, f"{tmp_path}/c")
    for feed in "abc":
        assert _files(tmp_path / feed, ".json.gz") and not _files(tmp_path / feed, ".json")
    rows = [sorted(r.event.asDict(True).items().__repr__() for r in read_scoreboard(spark, f"{tmp_path}/{f}").select("event").collect())
            for f in "ab"]
    assert rows[0] == rows[1] and len(rows[0]) == matches.count()


def test_events_are_rendered_after_they_are_dealt_out(spark, handmade):
    teams, matches = handmade
    plan = _plan(render_events(matches, teams, deal=FEED_ORDER))
    dealt = plan.index("rangepartitioning")
    assert "homeAway" in plan[:dealt] and "homeAway" not in plan[dealt:]


def test_a_query_lands_only_the_feed_it_reads(spark):
    from pitchside.plans import deliveries as dl

    sf = "/root/testdata/sf0.001"
    d = dl.Landed(dl.landed(spark, sf).root + "-alone", dl.league(spark, sf), None, None)
    assert d.feed and os.path.isdir(d.feed.removeprefix("file:")) and not os.path.exists(f"{d.root}/upsert".removeprefix("file:"))


def test_numbering_shuffles_its_rows_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select("id", (F.col("id") % 7).alias("g"), F.col("id").cast("timestamp").cast("timestamp_ntz").alias("at"))
        plan = _plan(running_number(df, ["g"], [F.col("at"), F.col("id")], "n", kickoff_slice(F.col("at"))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the rows; their counts by slice, by group, and by slice for the join
    assert plan.count("Exchange hashpartitioning") == 4


def test_a_row_without_a_slice_counts_first_but_has_no_number(spark):
    df = spark.sql("select 1 as g, id, if(id = 2, null, timestamp_ntz'2001-01-01') as at from range(4)")
    got = running_number(df, ["g"], [F.col("at"), F.col("id")], "n", kickoff_slice(F.col("at"))).collect()
    assert sorted((r.id, r.n) for r in got) == [(0, 2), (1, 3), (3, 4)]


def test_clubs_of_a_feed_are_reduced_by_hash_and_the_last_name_stays(spark):
    side = "struct<external_id:string,name:string,short_name:string,crest_url:string,primary_color:string,secondary_color:string>"
    team = lambda i, n: (i, n, n, None, None, None)
    rows = [(1, (1, None, "a", 0, 5, 1), "m1", team("x", "old"), team("y", "y1")),
            (1, (1, None, "a", 0, 5, 2), "m2", team("x", "newer"), team("x", "newest of a")),      # away after home
            (1, (1, None, "a", 0, 4, 9), "m3", team("x", "earlier row"), team("y", "y0")),
            (1, (1, None, "b", 0, 1, 0), "m4", team("z", "z"), team("y", "y of b")),
            (2, (2, None, "a", 0, 0, 0), "m5", team("z", ""), team("y", "y of 2"))]
    good = spark.createDataFrame(rows, "delivery int, arrival struct<delivery:int,landed:timestamp,file:string,block:bigint,row:bigint,"
                                       f"pos:int>, external_id string, home {side}, away {side}")
    latest, nameless = incoming_teams(good)
    assert "HashAggregate" in _plan(latest)
    assert sorted((r.external_id, r.name, r.first_delivery) for r in latest.collect()) == [
        ("x", "newest of a", 1), ("y", "y of 2", 1), ("z", "z", 1)]
    assert [r.external_id for r in nameless.collect()] == ["m5"]


def test_files_of_a_landed_delivery_do_not_grow_with_the_competitions(spark, handmade, tmp_path):
    teams, matches = handmade
    many = matches.crossJoin(spark.range(40).select(F.col("id").alias("k"))).coalesce(2).withColumns({
        "id": F.col("id") + F.col("k") * 100, "external_id": F.concat("external_id", F.lit("-"), F.col("k").cast("string")),
        "competition": F.concat(F.lit("00"), F.col("k").cast("string"))})
    land_delivery(many, teams.coalesce(1), f"{tmp_path}/feed", 3)
    assert 1 <= len(_files(tmp_path / "feed", ".json.gz")) <= 16
    got = read_scoreboard(spark, f"{tmp_path}/feed").select("delivery", "competition", "event.id")
    want = many.select(F.lit(3), "competition", "external_id")
    assert got.count() == 360 and got.exceptAll(want).count() == 0


def test_a_folder_names_the_competition_then_the_payload(spark, tmp_path):
    line = '{"competition": "p.1", "events": [{"id": "a"}]}\n{"events": [{"id": "b"}]}'
    for at in ("f/delivery=1/competition=f.1", "p/delivery=1", "n"):
        (tmp_path / at).mkdir(parents=True)
        (tmp_path / at / "x.json").write_text(line)
    got = {f: sorted((r.delivery, r.competition, r.id) for r in read_scoreboard(spark, f"{tmp_path}/{f}").select(
        "delivery", "competition", "event.id").collect()) for f in "fpn"}
    assert got == {"f": [(1, "f.1", "a"), (1, "f.1", "b")], "p": [(1, "eng.1", "b"), (1, "p.1", "a")], "n": [(0, "eng.1", "b"), (0, "p.1", "a")]}


def test_empty_files_of_many_folders_by_one_listing(spark, tmp_path):
    from pitchside.sources import files

    for f in "ab":
        (tmp_path / f / "in").mkdir(parents=True)
        (tmp_path / f / "full.json").write_text("{}")
        (tmp_path / f / "_SUCCESS").write_text("")
    assert files.empty_files(spark, str(tmp_path)) == []
    (tmp_path / "a" / "in" / "no thing%.json").write_text("")
    (tmp_path / "b" / "nothing.json").write_text("")
    assert files.empty_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")]) == [
        f"file:{tmp_path}/a/in/no thing%.json", f"file:{tmp_path}/b/nothing.json"]


def test_no_stage_is_left_to_the_interpreter(spark, handmade, tmp_path):
    """A method too long for HotSpot is not compiled; Spark must not make one stage of it."""
    teams, matches = handmade
    land_delivery(matches, teams, f"{tmp_path}/feed", 1)
    events = read_scoreboard(spark, f"{tmp_path}/feed")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    assert "lambda" not in _plan(events)                         # nor are the events of a payload taken one by one


def test_numbering_sorts_by_numbers_first(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g"), F.col("id").cast("timestamp").cast("timestamp_ntz").alias("at"))
    plan = _plan(running_number(df, ["g"], [F.col("at"), F.col("id")], "n", kickoff_slice(F.col("at"))))
    assert "Sort [_hash" in plan and "Sort [_at" not in plan
