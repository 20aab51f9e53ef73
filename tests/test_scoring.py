"""Stored trees against MLlib, the round against its curve, and live and streamed scores against the batch."""

import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from harborlight.plans import learning as L
from harborlight.plans import models, planner, scoring
from harborlight.plans.trips import ride_times
from harborlight.sources import tables as T
from harborlight.streaming import keyed
from harborlight.streaming.jobs import in_parts


@pytest.fixture(scope="module")
def frozen(spark, sf_dir):
    rows = scoring.matrix(spark, sf_dir)
    return scoring.freeze(spark, sf_dir, rows, rounds=6), rows


def test_walking_the_nodes_equals_mllib(spark):
    """With a category of many values, whose effect no threshold could follow."""
    rows = spark.range(4_000).selectExpr("cast(id % 60 as string) AS name", "cast(hash(id) % 100 AS double) AS v")
    rows = rows.withColumn("label", ((F.pmod(F.hash("name"), F.lit(7)) < 3) != (F.col("v") > 40)).cast("double")).withColumn("y", F.col("label") > 0)
    rows = rows.withColumns({c: F.col("v") if c == "f_docks_now" else F.lit(0.0) for c in scoring.INPUTS[:-1]})
    folder = f"{keyed.shared_folder(spark)}/trees-test"
    model = scoring.fitted(rows, folder, rounds=5)
    nodes = scoring.nodes_of(spark, folder)
    labels = spark.createDataFrame([(n, float(i)) for i, n in enumerate(model.stages[0].labels)], "name string, station_index double")
    odd = rows.limit(1).withColumn("name", F.lit("unknown"))
    both = rows.unionByName(odd)
    mine = scoring.scored(scoring.vectors(both, labels), scoring.trees_of(nodes)).select("name", "v", "p_raw").distinct()
    theirs = model.transform(both).select("name", "v", F.element_at(vector_to_array("probability"), 2).alias("q")).distinct()
    worst = mine.join(theirs, ["name", "v"]).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p_raw") - F.col("q"))).alias("off")).first()
    assert worst.n > 1_000 and worst.off < 1e-12
    assert nodes.where("categories is not null and size(categories) > 1").count() > 0
    again = PipelineModel.load(folder)
    assert scoring.digest_of(nodes) == scoring.digest_of(scoring.nodes_of(spark, folder)) and len(again.stages) == 3
    last = scoring.curve(scoring.vectors(rows, labels), scoring.trees_of(nodes)).orderBy(F.desc("round")).first()
    q = F.element_at(vector_to_array("probability"), 2)
    loss = model.transform(rows).agg(-F.avg(F.when(F.col("y"), F.ln(q)).otherwise(F.ln(1 - q)))).first()[0]
    assert last["round"] == 5 and abs(last.loss - loss) < 1e-9


def test_many_stations_share_categories_by_rate(spark):
    """Bins, nodes and fits would grow with the stations otherwise."""
    rows = spark.range(6_000).selectExpr("cast(id % 100 as string) AS name", "cast(id div 100 < id % 100 % 50 as double) AS label")
    own = scoring.categories(rows, 100).collect()
    assert len(own) == 100 and all(r.name == r.category for r in own)
    few = {int(r.name): r.category for r in scoring.categories(rows, 8).collect()}
    assert len(few) == 100 and len(set(few.values())) == 8 and all(few[i] == few[i + 50] for i in range(50))
    assert [few[i] for i in range(50)] == sorted(few[i] for i in range(50))


def test_grouped_stations_are_scored_by_their_category(spark, sf_dir, frozen, monkeypatch):
    monkeypatch.setattr(scoring.categories, "__defaults__", (4,))
    folder = scoring.freeze(spark, sf_dir, frozen[1], rounds=2)
    labels = spark.read.schema("name string, station_index double").json(f"{folder}/labels")
    stations = frozen[1].where(F.col("d") <= L.TRAIN[1] - scoring.CHECK).select("name").distinct().count()
    assert labels.count() == stations > 4 and labels.select("station_index").distinct().count() <= 4
    assert scoring.predicted(spark, folder, frozen[1]).where("p between 0 and 1").count() == frozen[1].count()


@pytest.mark.parametrize(
    "losses, best", [([0.5, 0.4, 0.3], 3), ([0.5, 0.4, 0.45, 0.44, 0.43], 2), ([0.5, 0.4, 0.5, 0.5, 0.5, 0.5, 0.5, 0.1], 2), ([0.5, 0.4, 0.5, 0.5, 0.5, 0.5, 0.3], 7), ([0.2], 1), ([0.2, 0.2], 1)]
)
def test_patience(losses, best):
    assert scoring.chosen_round(list(enumerate(losses, 1)), 5) == best


def test_kept_round_is_that_of_the_curve_and_nodes_are_checked(spark, sf_dir, frozen):
    folder, rows = frozen
    losses = [(r["round"], r.loss) for r in spark.read.json(f"{folder}/curve").collect()]
    model = spark.read.schema(scoring.MODEL).json(f"{folder}/model").first()
    nodes = scoring.load_nodes(spark, folder)
    assert len(losses) == 6 and model.rounds == scoring.chosen_round(losses)
    assert nodes.select("tree").distinct().count() == model.rounds and scoring.digest_of(nodes) == model.digest
    (part,) = Path(f"{folder}/nodes".removeprefix("file:")).glob("part-*")
    text = part.read_text()
    part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    part.write_text(text.replace('"leaf":', '"leaf":1', 1))
    with pytest.raises(ValueError, match="nodes"):
        scoring.predicted(spark, folder, rows)
    part.write_text(text)
    assert scoring.predicted(spark, folder, rows).where("p between 0 and 1").count() == rows.count()


def test_live_scores_equal_the_batch(spark, sf_dir, frozen):
    folder, _ = frozen
    readings = T.readings(spark, sf_dir)
    whole = {(r.sid, r.t): r for r in scoring.live(spark, folder, readings, L.examples_now(readings)).collect()}
    assert len(whole) == readings.where("ok").count()
    lookback, now = scoring.latest(readings)
    assert lookback.count() < readings.count()
    some = scoring.live(spark, folder, lookback, L.examples_now(now)).collect()
    assert some and all(whole[r.sid, r.t] == r for r in some)
    stream_folder = in_parts(spark, sf_dir)
    stream = spark.readStream.schema(spark.read.parquet(stream_folder).schema).option("maxFilesPerTrigger", 1).parquet(stream_folder)
    found = keyed.scored_captures(stream, folder, lambda back, ex: scoring.live(spark, folder, back, ex)).collect()
    assert len(found) == len(whole) and all(whole[r.sid, r.t] == r for r in found)


def test_streamed_refit_equals_the_weekly_one(spark, sf_dir, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), int(d), bool(rng.random() < p * p), float(p)) for i, (d, p) in enumerate(zip(rng.integers(1, 31, 3_000), rng.random(3_000)))]
    frame = spark.createDataFrame(rows, "sid long, t timestamp, d long, y boolean, p double")
    for week in range(5):
        frame.where(F.floor((F.col("d") - 1) / 7) == week).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    got = {r.sid: r.p_roll for r in keyed.refitted(stream, least=100).collect()}
    expected = {r.sid: (r.p_roll, r.p, r.week) for r in models.rolling(frame, least=100).collect()}
    assert len(got) == 3_000 and all(abs(got[k] - v[0]) < 1e-12 for k, v in expected.items())
    assert sum(abs(v[0] - v[1]) > 1e-3 for v in expected.values()) > 1_500 and all(v[0] == v[1] for v in expected.values() if v[2] == 0)


def test_plans_use_the_stored_models(spark, sf_dir):
    board = scoring.scored_board(spark, sf_dir, rounds=2)
    plans = planner.ranked(planner.candidates(planner.requests(spark, sf_dir), board), board, ride_times(spark, sf_dir)).collect()
    known = {r.station_id: r for r in board.collect()}
    assert plans and all(r.p_full is None or min(known[r.station_id][f"p_full_{h}"] for h in scoring.SCALED) - 1e-9 <= r.p_full <= max(known[r.station_id][f"p_full_{h}"] for h in scoring.SCALED) + 1e-9 for r in plans)
    assert all((known[r.station_id].p_full_15 is None) == (r.p_full is None) and (r.rank is not None) == bool(r.recommendable) for r in plans)
    assert any(r.p_full is not None for r in plans)


def numbers(rows):
    names = [c for c in scoring.INPUTS if c != "station_index"]
    found = rows.select("sid", "t", "d", "y", "label", "weekend", "target_slot", "name", *(F.round(c, 9).alias(c) for c in names)).collect()
    return sorted(map(str, found))


def test_examples_of_several_horizons_equal_those_of_each(spark):
    """Bounds of the tolerance, readings out of service, and states or marks that are null."""
    rng, start = np.random.default_rng(6), dt.datetime(2024, 1, 1)
    times = sorted({(int(s), int(m) * 30) for s, m in zip(rng.integers(0, 5, 1_500), rng.integers(0, 700, 1_500))})
    rows = [(s, start + dt.timedelta(minutes=m), 1 + m // 1_440, rng.choice([True, True, False, None]), rng.choice([True, False, None]), int(rng.integers(0, 9))) for s, m in times]
    readings = spark.createDataFrame(rows, "sid long, t timestamp_ntz, d long, ok boolean, is_full boolean, docks long").withColumn("capacity", F.lit(20))
    horizons = (720, 1_080, 1_440)
    found = L.examples_of(readings, horizons).collect()
    for h in horizons:
        one = {(r.sid, r.t, r.slot, r.full_now, r[f"y{h}"].y) for r in found if r[f"y{h}"]}
        expected = {(r.sid, r.t, r.slot, r.full_now, r.y) for r in L.examples(readings, h).collect()}
        assert one == expected and len(one) > 100 and {x[-1] for x in one} == {True, False, None}
    assert all(any(r[f"y{h}"] for h in horizons) for r in found)


def test_features_of_several_horizons_equal_those_of_each(spark, sf_dir):
    shared, horizons = scoring.shared_tables(spark, sf_dir), tuple(scoring.SCALED.values())
    r = shared["readings"]
    rows = scoring.several(r, shared, L.examples_of(r, horizons), horizons)
    for h in horizons:
        each = L.features(r, T.last_of_day(r), shared["flow"], shared["weather"], L.examples(r, h), h)
        expected = numbers(scoring.indexed(each).withColumn("label", F.col("y").cast("double")))
        assert expected and numbers(scoring.at_horizon(rows, h)) == expected


def test_the_board_computes_once_what_its_horizons_share(spark, sf_dir, monkeypatch):
    """Readings, flows and lags were computed anew for each horizon, which took most of the time of large tables."""
    calls = {"flow_of": 0, "lag_values": 0}

    def counted(module, name):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **b: (calls.update({name: calls[name] + 1}), real(*a, **b))[1])

    counted(scoring, "flow_of")
    counted(L.asof, "lag_values")
    monkeypatch.setattr(scoring, "freeze", lambda *a, **b: "none")
    monkeypatch.setattr(scoring, "live", lambda spark, folder, lookback, ex, horizon: ex.withColumn("p", F.lit(0.5)))
    monkeypatch.setattr(scoring, "predicted", lambda spark, folder, rows: rows.withColumn("p", F.lit(0.5)))
    assert scoring.scored_board(spark, sf_dir).where("p_full_45 = 0.5").count() > 0
    assert calls == {"flow_of": 1, "lag_values": 2}  # of the examples and of the last readings


def test_means_that_differ_by_the_order_of_their_sum_are_one_value(spark):
    """Splits are taken from the different values of a feature, so fits differed between runs."""
    raw = [c for c in scoring.NUMBERS if c not in ("nb_occupancy_mean", "temperature_now")]
    rows = spark.createDataFrame([((0.1 + 0.2) + 0.3,), (0.1 + (0.2 + 0.3),)], "nb_occupancy_mean double")
    assert rows.distinct().count() == 2
    rows = rows.withColumn("temperature_now", F.col("nb_occupancy_mean")).withColumns({c: F.lit(1.0) for c in [*raw, "sid"]} | {"holiday": F.lit(False)})
    assert scoring.indexed(rows).select("f_nb_occupancy_mean", "f_temperature_now").distinct().count() == 1
