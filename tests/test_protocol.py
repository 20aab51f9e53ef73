"""Splits, fitted persistence, stored artifacts and ranked places by cases and against brute force."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from harborlight.functions import geo
from harborlight.plans import live, protocol
from harborlight.streaming import jobs


@pytest.mark.parametrize(
    ("days", "dev", "expected"),
    [
        ([], (), []),
        ([1, 2], (), ["train"] * 2),
        ([1, 2, 3], (), ["train", "train", "report"]),
        ([1, 2, 3, 4], (2, 3), ["train"] * 4),
        ([1, 2, 3, 4, 5, 6], (2,), ["train", "train", "train", "train", "fit", "report"]),
        (list(range(1, 11)), (), ["train"] * 6 + ["fit"] * 2 + ["report"] * 2),
    ],
)
def test_ordered_split(spark, days, dev, expected):
    rows = protocol.ordered_split(spark.createDataFrame([(d,) for d in days], "d int"), "d", dev or (99,))
    assert [r.part for r in rows.orderBy("d").collect()] == expected


def test_period_of(spark):
    days = {date(2024, 8, 31): None, date(2024, 9, 1): "train", date(2025, 7, 15): None, date(2025, 9, 30): "fit", date(2026, 2, 1): None, date(2026, 9, 10): None, date(2026, 9, 11): "test_late"}
    rows = spark.createDataFrame([(d,) for d in days], "day date").select("day", protocol.period_of(F.col("day")).alias("p")).collect()
    assert {r.day: r.p for r in rows} == days


def test_calibrated_persistence_falls_back(spark):
    rows = [(1, True, n % 4 == 0, True) for n in range(20)] + [(2, True, True, True)] * 5 + [(3, False, None, True), (3, False, False, True), (4, True, None, False), (1, True, None, False)]
    frame = spark.createDataFrame(rows, "sid long, full_now boolean, y boolean, train boolean")
    got = {(r.sid, r.full_now): r.p_persist_cal for r in protocol.calibrated_persistence(frame, F.col("train")).collect()}
    assert got == pytest.approx({(1, True): 0.25, (2, True): 0.4, (3, False): 0.0, (4, True): 0.4})


def test_artifacts_of_one_side_differ(spark):
    folder = live.fresh_folder(spark, "frozen")
    rows = spark.createDataFrame([(2, 0.5), (1, None)], "sid int, p double")
    for side, names in (("a", ("x", "y")), ("b", ("x", "z"))):
        for name in names:
            protocol.store_text(rows.orderBy("sid" if side == "a" else F.desc("sid")), ["sid"], f"{folder}/{side}/{name}")
    got = protocol.compared(protocol.digests(spark, f"{folder}/a"), protocol.digests(spark, f"{folder}/b"))
    assert {r.name: r.same for r in got.collect()} == {"x": True, "y": False, "z": False}


def test_suggestions(spark):
    names = [
        (1, "Metro Roma", ["metro"], 0, 1, 19.0, -99.0), (2, "Roma Norte", ["metro"], 1, 1, 19.0, -99.0), (3, "Plaza Roma", ["plaza"], 0, 1, 19.0, -99.0),
        (4, "Roma Sur Metropolitana", ["barrio"], 0, 1, 19.0, -99.0), (5, "roma  norte", ["metro"], 2, 1, 19.0, -99.0), (6, "Metro", ["metro"], 0, 1, 19.0, -99.0),
        (7, None, ["metro"], 0, 1, 19.0, -99.0),
    ]
    frame = spark.createDataFrame(names, "place_id long, name string, kind_words array<string>, kind_rank int, context int, lat double, lon double")
    asked = spark.createDataFrame([(1, "roma metro", 19.0, -99.0), (2, "", 19.0, -99.0), (3, None, 19.0, -99.0), (4, "plaza", 19.0, -99.0)], "ask long, query string, lat0 double, lon0 double")
    got = protocol.suggested(frame, asked).orderBy("ask", "place").collect()
    # the kind was typed for 2; 6 has one word of its name and no "roma"; 5 is 2 with another writing
    assert [(r.ask, r.place_id) for r in got] == [(1, 2), (1, 1), (1, 4), (4, 3)]


def test_suggestions_meet_places_around_the_point_only(spark, monkeypatch):
    """3,000 places of one word over a degree, a few kinds far away: the same as by comparing all, with few pairs met."""
    names = spark.range(3_000).selectExpr(
        "id AS place_id", "concat('Roma ', id % 40) AS name", "array('metro') AS kind_words", "if(id % 997 = 3, 0, 1) AS kind_rank", "cast(id % 3 as int) AS context",
        "if(id = 8, null, 19.0 + (id * 37 % 1000) / 1000D) AS lat", "-99.0 + (id * 53 % 1000) / 1000D AS lon",
    )
    asked = spark.range(30).selectExpr("id AS ask", "if(id % 2 = 0, 'rom', 'rom metro') AS query", "19.0 + id / 30D AS lat0", "if(id = 7, null, -99.0 + id / 30D) AS lon0")
    met, within = [], protocol.met_within
    monkeypatch.setattr(protocol, "met_within", lambda *a: met.append(within(*a)) or met[-1])
    got = {(r.ask, r.place): r.place_id for r in protocol.suggested(names, asked).collect()}
    metres = F.round(geo.flat_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))).cast("long")
    every = asked.crossJoin(names).withColumn("o", F.struct("kind_rank", metres.alias("metres"), F.length("name").alias("letters"), "name", "place_id"))
    one = every.groupBy("ask", "name", "context").agg(F.min("o").alias("o"))
    place = F.row_number().over(Window.partitionBy("ask").orderBy("o"))
    expected = {(r.ask, r.place): r.id for r in one.select("ask", place.alias("place"), F.col("o.place_id").alias("id")).where("place <= 5").collect()}
    assert len(got) == 150 and got == expected
    assert sum(m.where("lon0 is not null").count() for m in met) < 30_000


def test_blobs_are_replaced_by_key(spark):
    folder = live.fresh_folder(spark, "blobs")
    put = lambda *rows: live.put_blobs(spark.createDataFrame(rows, "key string, body string"), folder)
    put(("a/b=1.json", "one\ntwo"), ("c", ""))
    put(("c", "again"), ("d", None))
    assert {r.key: r.body for r in live.get_blobs(spark, folder).collect()} == {"a/b=1.json": "one\ntwo", "c": "again", "d": None}


def test_captures_are_scored_once(spark, sf_dir):
    folder = live.fresh_folder(spark, "twice")
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(20).write.parquet(folder)
    again = spark.read.parquet(folder)
    again.unionByName(again).coalesce(1).write.parquet(f"{folder}-all")
    rates = spark.createDataFrame([], "sid long, p double")
    got = jobs.drained(jobs.scored(jobs.feed(spark, f"{folder}-all"), rates, 0.25)).collect()
    assert len(got) == again.where("event_type <> 'error'").select("user_id", "ts").distinct().count() and {r.p for r in got} == {0.25}
