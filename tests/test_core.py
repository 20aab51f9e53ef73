from __future__ import annotations

import bisect
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlight.functions import geo, prob, text, timeparts
from harborlight.operators import asof, metrics
from harborlight.operators import stations as S
from harborlight.plans import city, learning, live, models, planner, search, trips
from harborlight.sources import tables, trip_files
from harborlight.streaming import jobs

T0 = datetime(2024, 1, 8, 9, 0)
READING = "sid long, t timestamp_ntz, d long, ok boolean, is_full boolean, docks int, bikes int, docks_disabled int, capacity int, lat double, lon double"


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def reading(sid, minutes, docks, ok=True, lat=19.4, lon=-99.1):
    return (sid, at(minutes), at(minutes).day, ok, docks == 0, docks, 20 - docks, 0, 20, lat, lon)


def frame(spark, rows):
    return spark.createDataFrame(rows, READING)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lags(spark, rows, centered, lag=15, tolerance=7.5):
    r = frame(spark, rows)
    got = asof.lag_values(r.select("sid", "t"), r.select("sid", "t", "docks", "ok"), ["sid"], "t", "docks", "ok", (lag,), tolerance, centered, "lag")
    return {(x.t - T0).seconds / 60: x[f"lag{lag}"] for x in got.collect()}


def test_lags_trailing_and_centered(spark):
    rows = [reading(1, m, d) for m, d in ((0, 9), (17, 8), (30, 7), (45, 6))]
    assert lags(spark, rows, False) == {0: None, 17: 9, 30: None, 45: 7}
    assert lags(spark, rows, True) == {0: None, 17: 9, 30: 8, 45: 7}


def test_a_tie_takes_the_earlier_reading_and_a_bad_one_none(spark):
    rows = [reading(1, 0, 5), reading(1, 10, 3), reading(1, 20, 7)]
    assert lags(spark, rows, True)[20] == 5
    rows[0] = reading(1, 0, 5, ok=False)
    assert lags(spark, rows, True)[20] == 3
    assert lags(spark, rows, False)[20] is None


def test_asof_equals_bisection(spark):
    random = np.random.default_rng(4)
    left = [(int(s), at(float(m))) for s, m in zip(random.integers(0, 4, 80), random.integers(0, 900, 80))]
    right = [(int(s), at(float(m)), i) for i, (s, m) in enumerate({(s, m) for s, m in zip(random.integers(0, 4, 70), random.integers(0, 900, 70))})]
    l, r = spark.createDataFrame(left, "sid long, t timestamp_ntz"), spark.createDataFrame(right, "sid long, rt timestamp_ntz, v long")
    for look, forward in ((asof.forward, True), (asof.backward, False)):
        got = sorted((x.sid, x.t, x._hit.v if x._hit else None) for x in look(l, r, ["sid"], F.col("t"), "rt", ["v"]).collect())
        expected = []
        for s, t in left:
            times = sorted((rt, v) for k, rt, v in right if k == s)
            i = bisect.bisect_left(times, (t, -1)) if forward else bisect.bisect_right(times, (t, 10**6)) - 1
            expected.append((s, t, times[i][1] if 0 <= i < len(times) else None))
        key = lambda x: (x[0], x[1], str(x[2]))
        assert sorted(got, key=key) == sorted(expected, key=key)
    hit = asof.forward_buckets(l.distinct(), r, ["sid"], F.col("t"), timeparts.plus_minutes(F.col("t"), 60), "rt", ["v"], 30)
    near = {(x.sid, x.t): x._hit.v for x in hit.collect()}
    whole = asof.forward(l.distinct(), r, ["sid"], F.col("t"), "rt", ["v"]).where("_hit is not null and _hit.t <= t + interval 60 minutes")
    assert near == {(x.sid, x.t): x._hit.v for x in whole.collect()}


def test_a_bad_first_reading_drops_the_example(spark):
    rows = [reading(1, 0, 4), reading(1, 9, 0, ok=False), reading(1, 14, 0), reading(2, 0, 4), reading(2, 9, 0), reading(2, 30, 2)]
    got = {(x.sid, (x.t - T0).seconds / 60): x.y for x in learning.examples(frame(spark, rows), 15, 7).collect()}
    assert got == {(2, 0): True, (2, 9): False}
    assert learning.examples_now(frame(spark, rows), 15).where("y is null").count() == 5


def test_labels_in_order(spark):
    rows = [(True, 10_800, False), (True, 10_801, True), (True, None, False), (False, 99_999, True), (True, 0, True)]
    got = spark.createDataFrame(rows, "s boolean, a int, f boolean").select(S.label(F.col("s"), F.col("a"), F.col("f")).alias("l")).collect()
    assert [x.l for x in got] == ["available", "stale", "stale", "unavailable", "full"]


def test_wall_clock_twice_and_never(spark):
    rows = spark.createDataFrame([("30/10/2022 01:30:00",), ("3/4/2022 02:30:00",), ("1/6/2022 12:00:00",), ("x",)], "s string")
    got = [x.t for x in rows.select(timeparts.local_wall_clock(F.col("s"), "d/M/yyyy HH:mm:ss", "America/Mexico_City").cast("string").alias("t")).collect()]
    assert got == ["2022-10-30 06:30:00", None, "2022-06-01 17:00:00", None]


def test_trip_files_of_all_header_styles(spark, tmp_path):
    long = 'Genero_Usuario,Edad_Usuario,Bici,Ciclo_Estacion_Retiro,Fecha_Retiro,Hora_Retiro,Ciclo_EstacionArribo,"Fecha Arribo",Hora_Arribo\nM,24,8015364,112,30/09/2022,23:22:32,64,01/10/2022,00:01:58\n'
    quoted = '"Genero_Usuario","Bici","Ciclo_Estacion_Retiro","Fecha_Retiro","Hora_Retiro","Ciclo_EstacionArribo","Fecha_Arribo","Hora_Arribo"\n"F",5254487,"390-391","31/08/2024","23:55:44","064","01/09/2024","00:00:00"\n'
    short = "\ufeffGenero_usuario,Bici,CE_retiro,Fecha_retiro,Hora_retiro,CE_arribo,Fecha_arribo,Hora_arribo\nF,14112,136,31/08/22,23:55:30,135,01/09/22,0:00:27\nF,x,1000,bad,8:00:00,12,,\n"
    names = ["2022-09.csv", "viajes_2024_agosto.csv", "2022-08-1.csv", "2022-08.csv", "readme.csv"]
    for name, text in zip(names, (long, quoted, "no,header\n", short, "")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows = {r.bike_id: r for r in trip_files.read_months(spark, [str(tmp_path / n) for n in names if n != "2022-08-1.csv"]).collect()}
    got = {k: (r.month, r.origin_code, r.destination_code, str(r.departed_at), r.duration_min and round(r.duration_min, 4)) for k, r in rows.items()}
    assert got == {
        "8015364": ("2022-09", "112", "064", "2022-10-01 04:22:32", 39.4333), "5254487": ("2024-08", "390-391", "064", "2024-09-01 05:55:44", 4.2667),
        "14112": ("2022-08", "136", "135", "2022-09-01 04:55:30", 4.95), "x": ("2022-08", "1000", "012", "None", None),
    }
    with pytest.raises(ValueError, match="bike_id"):
        trip_files.read_trips(spark, str(tmp_path / "2022-08-1.csv"))


def test_month_of_name(spark):
    cases = {"2024-09.csv": "2024-09", "2025-10-1.csv": "2025-10", "a_2022_10.csv": "2022-10", "datos_abiertos_2024_03-1-1.csv": "2024-03", "d_2023_octubre.csv": "2023-10",
             "e_2024_Enero.csv": "2024-01", "public_data_web_2026-08_2.csv": "2026-08", "2010-02-feb.csv": "2010-02", "readme.csv": None, "202311.csv": None, "2021-13.csv": None}
    rows = spark.createDataFrame([(k,) for k in cases], "name string")
    assert {r.name: r.m for r in rows.select("name", text.month_of_name(F.col("name")).alias("m")).collect()} == cases
    uploads = spark.createDataFrame([("x/2024-09.csv",), ("x/2024-09_2.csv",), ("x/readme.csv",)], "name string")
    assert [tuple(r) for r in trip_files.newest(uploads).collect()] == [("2024-09", "x/2024-09_2.csv")]


def test_nearest_stations_equal_brute_force(spark):
    import random

    from harborlight.plans import planner

    r = random.Random(4)
    stations = [(i, 19.4 + r.random() * 0.02, -99.2 + r.random() * 0.02) for i in range(80)]
    asked = [(i, r.randrange(80), 19.39 + r.random() * 0.04, -99.21 + r.random() * 0.04) for i in range(60)]
    metres = lambda a, b: 2 * 6371000.0 * math.asin(math.sqrt(math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)) * 1.3
    expected = set()
    for q, origin, *p in asked:
        order = sorted((metres(p, s), i) for i, *s in stations if i != origin)
        expected |= {(q, i) for n, (m, i) in enumerate(order) if m <= 500 or n < 2}
    frames = spark.createDataFrame(asked, "request_id long, origin_id long, to_lat double, to_lon double"), spark.createDataFrame(stations, "station_id long, lat double, lon double")
    assert {(x.request_id, x.station_id) for x in planner.candidates(*frames).collect()} == expected


def test_gzip_captures(spark, tmp_path):
    import gzip

    good = '{"last_updated": 5, "ttl": 10, "x": 1, "data": {"stations": [{"station_id": "a", "num_docks_available": 3, "extra": 1}, {"station_id": "b"}]}}'
    for n, doc in enumerate((good, "[]", '{"last_updated": 6, "data": {"stations": []}}', "no json")):
        with gzip.open(tmp_path / f"{n}.json.gz", "wt") as f:
            f.write(doc)
    got = tables.read_feed(spark, str(tmp_path)).orderBy("station_id").collect()
    assert [(x.last_updated, x.station_id, x.num_docks_available) for x in got] == [(5, "a", 3), (5, "b", None)]


def test_neighbours_equal_all_pairs(spark):
    random = np.random.default_rng(9)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(random.uniform(60.0, 60.02, 120), random.uniform(-0.02, 0.02, 120)))]
    st = spark.createDataFrame(rows, "sid long, lat double, lon double")
    x, y = st.toDF("a", "la", "oa"), st.toDF("b", "lb", "ob")
    every = x.crossJoin(y).where("a <> b").where(geo.haversine_m(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob")) <= 300)
    assert {(r.a, r.b) for r in S.neighbours(st).collect()} == {(r.a, r.b) for r in every.collect()}


def test_out_of_service_neighbours_count_as_not_full(spark):
    grid = frame(spark, [reading(2, 0, 0, ok=False), reading(3, 0, 0)]).withColumn("g", F.col("t"))
    edges = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    r = S.neighbour_state(edges, grid).first()
    assert (r.nb_n, r.nb_full_frac, r.nb_occupancy_mean, r.nb_docks_sum) == (2, 0.5, 1.0, 0)


def test_gaps_run_across_days(spark):
    t = spark.createDataFrame([(at(0),), (at(0),), (at(10),), (at(3000),)], "t timestamp_ntz")
    assert [r.gap_min for r in S.gaps(t).orderBy("t").collect()] == [None, 10.0, 2990.0]


def test_flow_divides_by_all_days_and_wraps_midnight(spark):
    row = lambda o, d, start, end: (o, d, start, end, 10.0)
    day = timedelta(days=1)
    some = [row("a", "b", at(0), at(10)), row("a", "b", at(0) + day, at(10) + day), row("a", "c", at(0), at(10))]
    flow = {(r.station_id, r.slot): r.net_flow_mean for r in trips.flow_of(spark.createDataFrame(some, "origin_code string, destination_code string, departed_at timestamp_ntz, arrived_at timestamp_ntz, duration_min double")).collect()}
    assert flow == {("a", 36): -1.5, ("b", 36): 1.0, ("c", 36): 0.5}
    net = spark.createDataFrame([("a", False, 95, 2.0), ("a", False, 0, 3.0), ("a", False, 50, 100.0)], "station_id string, weekend boolean, slot long, net_flow_mean double")
    asked = spark.createDataFrame([("a", False, 94, 1), ("a", False, 49, 51), ("z", False, 1, 2)], "station_id string, weekend boolean, f long, e long")
    got = {(r.station_id, r.f): r.flow_net_window for r in trips.window_of(trips.cumulative(net), asked, "station_id", "f", "e").collect()}
    assert got == {("a", 94): 5.0, ("a", 49): 100.0, ("z", 1): 0.0}


def test_baselines_fall_back(spark):
    ex = lambda sid, full, slot, y, n, d=1: [(sid, full, slot, False, y, d)] * n
    rows = ex(1, False, 5, True, 20) + ex(2, False, 5, False, 19) + ex(2, False, 6, True, 1) + ex(9, True, 7, True, 1, 25)
    got = {(r.sid, r.target_slot): r for r in learning.baselines(spark.createDataFrame(rows, "sid long, full_now boolean, target_slot long, weekend boolean, y boolean, d long")).collect()}
    assert (got[1, 5].p_persist_cal, got[1, 5].p_hist) == (1.0, 1.0)
    assert (got[2, 5].p_persist_cal, got[2, 5].p_hist) == (0.05, 0.0)
    assert got[2, 6].p_hist == pytest.approx(0.05)
    assert (got[9, 7].p_persist, got[9, 7].p_persist_cal, got[9, 7].p_hist) == (1.0, None, pytest.approx(21 / 40))


def test_interpolation_and_ramp(spark):
    p = lambda m: value(spark, prob.at_minutes(F.lit(m), (15, 30, 45), [F.lit(0.1), F.lit(0.4), F.lit(0.2)]))
    assert [round(p(m), 6) for m in (0, 15, 20, 30, 40, 99)] == [0.1, 0.1, 0.2, 0.4, round(0.4 - 0.2 * 2 / 3, 6), 0.2]
    assert value(spark, prob.ramp(F.lit(0.6), F.lit(5.0))) == pytest.approx(0.2)
    assert value(spark, prob.skill(F.lit(0.1), F.lit(0.0))) is None
    xs, ys = F.array(F.lit(0.2), F.lit(0.6)), F.array(F.lit(0.1), F.lit(0.9))
    assert [value(spark, prob.along(F.lit(x), xs, ys)) for x in (0.0, 0.2, 0.4, 0.6, 1.0)] == [0.1, 0.1, pytest.approx(0.5), 0.9, 0.9]
    none = F.lit(None).cast("array<double>")
    assert value(spark, prob.along(F.lit(0.3), none, none)) == 0.3


def test_metrics(spark):
    rows = spark.createDataFrame([(True, "m", 1.0), (False, "m", 0.25), (True, "m", 0.95)], "y boolean, model string, p double")
    r = metrics.summarised(rows, ["model"]).first()
    assert r.brier == pytest.approx((0 + 0.0625 + 0.0025) / 3)
    assert r.log_loss == pytest.approx(-(math.log(1 - 1e-6) + math.log(0.75) + math.log(0.95)) / 3)
    assert {x.bin: x.n for x in metrics.reliability(rows, ["model"]).collect()} == {9: 2, 2: 1}


def test_plan_keeps_the_nearest_and_ranks_the_recommendable(spark):
    st = spark.createDataFrame([(1, 19.40, -99.1, "available", 5), (2, 19.41, -99.1, "full", 5), (3, 19.42, -99.1, "unavailable", 5), (4, 19.50, -99.1, "available", 0)], "station_id long, lat double, lon double, label string, bikes int").selectExpr("*", "0.5D p_full_15", "0.5D p_full_30", "0.5D p_full_45", "0.3D p_empty_15")
    req = spark.createDataFrame([(7, 1, 19.41, -99.1, 19.40, -99.1)], "request_id long, origin_id long, to_lat double, to_lon double, from_lat double, from_lon double")
    near = planner.candidates(req, st)
    assert {r.station_id for r in near.collect()} == {2, 3}
    rides = spark.createDataFrame([(1, 2, 12.0, 20), (1, 3, 9.0, 19)], "origin_id long, destination_id long, ride_min double, trips long")
    got = {r.station_id: r for r in planner.ranked(near, st, rides).collect()}
    assert (got[2].rank, got[2].ride_min, got[2].ride_source) == (1, 12.0, "median of 20 trips")
    assert (got[3].rank, got[3].recommendable) == (None, False)
    assert [r.station_id for r in planner.pickups(req, st).collect()] == [1]


def test_search_neither_broadcasts_names_nor_compares_them_twice(spark, tmp_path):
    spark.range(3_000).selectExpr("id AS place_id", "concat('Calle ', id % 3) AS name", "id % 2 AS kind_rank").write.parquet(f"{tmp_path}/names")
    names, asked = spark.read.parquet(f"{tmp_path}/names"), spark.createDataFrame([("cal 1",)], "query string")
    found = search.matches(names, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and found.count() == 1_000
    once = search.matches(search.kinds_once(names), asked)
    whole = [(r.place, r.place_id) for r in search.ranked_places(found).collect()]
    assert once.count() == 2 and whole == [(r.place, r.place_id) for r in search.ranked_places(once).collect()] == [(1, 4)]


def test_text(spark):
    assert value(spark, text.plain(F.lit("  Ávenida  Ñandú, #3 "))) == "avenida nandu 3"
    assert [value(spark, text.station_code(F.lit(x))) for x in (' "7" ', "1000", "390-391", "a1")] == ["007", "1000", "390-391", "a1"]
    assert value(spark, text.street_label(F.lit("Calle"), F.lit("Paseo X"))) == "Paseo X"
    names = spark.createDataFrame([(1, "Río de la Plata"), (2, "Plátano riojano"), (3, None), (4, "Riobambense plaza")], "place_id long, name string")
    asked = spark.createDataFrame([("pla rio",), ("lata",), ("riobambense",), ("",)], "query string")
    assert {(r.place_id, r.query) for r in search.matches(names, asked).collect()} == {(1, "pla rio"), (2, "pla rio"), (4, "pla rio"), (4, "riobambense")}


def test_folds_and_polyline(spark):
    pts = spark.createDataFrame([([(19.4, -99.1), (19.4001, -99.1), (19.41, -99.1), (19.4002, -99.1)],)], "p array<struct<lat:double,lon:double>>")
    r = pts.select(F.size(search.spaced(F.col("p"), 500.0)).alias("a"), F.size(search.thinned(F.col("p"), 500.0)).alias("b"), geo.nearest_on_polyline(F.lit(19.405), F.lit(-99.099), F.col("p")).alias("m")).first()
    assert (r.a, r.b) == (3, 2) and r.m == pytest.approx(104.9, abs=0.5)


def test_platt_recovers_its_parameters(spark):
    random = np.random.default_rng(2)
    p = random.uniform(0.02, 0.98, 20_000)
    y = random.uniform(size=len(p)) < 1 / (1 + np.exp(-(0.7 * np.log(p / (1 - p)) - 0.4)))
    a, b = models.platt(spark.createDataFrame(list(zip(p.tolist(), y.tolist())), "p double, y boolean"))
    assert a == pytest.approx(0.7, abs=0.06) and b == pytest.approx(-0.4, abs=0.06)


def test_isotonic_is_monotone(spark):
    rows = [(i / 100, (i * 7) % 10 < i / 10) for i in range(100)]
    xs, ys = models.isotonic(spark.createDataFrame(rows, "p double, y boolean"))
    assert xs == sorted(xs) and ys == sorted(ys)


def test_rolling_never_looks_ahead(spark):
    rows = [(d, (i % 10) / 10 + 0.05, (i % 10) >= 5, i) for d in range(1, 29) for i in range(40)]
    schema = "d long, p double, y boolean, i long"
    before = {(r.d, r.i): r.p_roll for r in models.rolling(spark.createDataFrame(rows, schema), least=50).collect()}
    changed = [(d, p, (not y) if d >= 21 else y, i) for d, p, y, i in rows]
    after = {(r.d, r.i): r.p_roll for r in models.rolling(spark.createDataFrame(changed, schema), least=50).collect()}
    assert all(before[k] == after[k] for k in before if k[0] <= 21)
    assert all(before[k] == pytest.approx((k[1] % 10) / 10 + 0.05) for k in before if k[0] <= 7)
    assert any(before[k] != after[k] for k in before)


def test_bootstrap_covers_the_skill(spark):
    random = np.random.default_rng(3)
    blocks = [(50, float(a), float(b)) for a, b in zip(random.uniform(4, 6, 60), random.uniform(9, 11, 60))]
    value_, low, high = models.bootstrap(spark.createDataFrame(blocks, "n long, m double, r double"), "m", "r")
    assert low < value_ < high and 0.4 < value_ < 0.6 and high - low < 0.1


def test_latest_lag(spark):
    schema = "event_id long, sid long, t timestamp, is_full boolean"
    old, new = spark.createDataFrame([(1, 1, at(0), True), (2, 2, at(0), True)], schema), spark.createDataFrame([(3, 1, at(5), False), (4, 2, at(90), False), (5, 3, at(1), True)], schema)
    assert {r.sid: r.was_full for r in jobs.latest_lag(old, new, 60).collect()} == {1: True, 2: None, 3: None}


def test_lookback_over_batches(spark, tmp_path):
    """A late row gets what came before it, and doesn't change what later rows were given."""
    rows = lambda part: spark.createDataFrame(part, "event_id long, sid long, t timestamp, is_full boolean").coalesce(1)
    for part in ([(1, 1, at(0), True)], [(2, 1, at(10), False), (3, 2, at(200), True)], [(4, 1, at(5), False), (5, 1, at(20), True)]):
        rows(part).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows([]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.event_id: (r.was_full, r.batch) for r in jobs.with_lookback(stream, 60).collect()}
    assert got == {1: (None, 0), 2: (True, 1), 3: (None, 1), 4: (True, 2), 5: (False, 2)}


def test_rolling_equals_a_plain_fit(spark):
    """Weeks against pooling by brute force: the monotone fit is the max over starts of the min over ends of means."""
    random = np.random.default_rng(5)
    rows = [(d, round(float(p), 2), bool(random.uniform() < p)) for d in range(1, 22) for p in random.uniform(0.05, 0.95, 30)]
    got = models.rolling(spark.createDataFrame(rows, "d long, p double, y boolean"), least=50).collect()
    for week in (1, 2):
        past = [(p, y) for d, p, y in rows if week * 7 - 28 < d <= week * 7]
        xs = sorted({p for p, _ in past})
        hit = {x: [y for p, y in past if p == x] for x in xs}
        mean = lambda i, j: sum(map(sum, (hit[x] for x in xs[i : j + 1]))) / sum(len(hit[x]) for x in xs[i : j + 1])  # noqa: E731,B023
        fit = [max(min(mean(a, b) for b in range(k, len(xs))) for a in range(k + 1)) for k in range(len(xs))]
        for r in got:
            if r.week == week:
                assert r.p_roll == pytest.approx(float(np.interp(r.p, xs, fit)), abs=1e-9)


def test_lanes_and_kinds(spark):
    tags = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    lanes = [{"highway": "cycleway"}, {"highway": "path", "bicycle": "no"}, {"cycleway:left": "lane", "cycleway:right": "track"}, {"cycleway": "separate"}, {"cycleway:both": "share_busway", "cycleway": "lane"}]
    assert [value(spark, city.lane_class(tags(d))) for d in lanes] == ["separated", None, "separated", None, "painted"]
    kinds = [
        {"place": "quarter", "building": "yes"}, {"public_transport": "platform", "network": "STC Metro", "railway": "subway"}, {"public_transport": "station", "operator": "Metrobús", "station": "subway"},
        {"public_transport": "stop"}, {"tourism": "museum", "building": "yes"}, {"building": "yes"}, {"amenity": "cafe"}, {"amenity": "college"},
    ]
    assert [value(spark, city.kind_of(tags(d))) for d in kinds] == ["Colonia", "Metro", "Metrobús", None, "Museo", "Edificio", None, "Universidad"]


def test_weather_keeps_the_first_document_of_an_hour(spark, tmp_path):
    docs = [
        '{"start": "2024-01-02", "hourly": {"time": ["2024-01-01T23:00", "2024-01-02T00:00"], "temperature_2m": [7, 8.5], "precipitation": [null, 0]}}',
        '{"start": "2024-01-01", "hourly": {"time": ["2024-01-01T23:00"], "temperature_2m": [6.5], "precipitation": [1]}}',
    ]
    spark.createDataFrame([(d,) for d in docs], "value string").write.text(f"{tmp_path}/w")
    assert [(str(r.hour), r.temp, r.precip) for r in city.read_weather(spark, f"{tmp_path}/w").orderBy("hour").collect()] == [("2024-01-01 23:00:00", 6.5, 1.0), ("2024-01-02 00:00:00", 8.5, 0.0)]


def test_boxes_and_walks(spark):
    assert value(spark, geo.in_box(F.lit(1.05), F.lit(2.0), 0.0, 1.0, 1.0, 3.0)) is False
    assert value(spark, geo.in_box(F.lit(1.05), F.lit(2.0), 0.0, 1.0, 1.0, 3.0, 0.1)) is True


def test_days_are_rebuilt_by_the_manifest(spark, tmp_path):
    rows = lambda pairs: spark.createDataFrame(pairs, "day string, x int").selectExpr("cast(day as date) AS day", "x")
    first = [("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-02", 3)]
    assert live.update_days(rows(first), "day", str(tmp_path)) == ["2024-01-01", "2024-01-02"]
    assert live.update_days(rows(first), "day", str(tmp_path)) == []
    assert live.update_days(rows([*first, ("2024-01-02", 4), ("2024-01-03", 5)]), "day", str(tmp_path)) == ["2024-01-02", "2024-01-03"]
    assert sorted(r.x for r in spark.read.parquet(f"{tmp_path}/days").collect()) == [1, 2, 3, 4, 5]
    assert live.update_days(rows([*first, ("2024-01-02", 9), ("2024-01-03", 5)]), "day", str(tmp_path)) == ["2024-01-02"]  # as many rows, another value
    assert sorted(r.x for r in spark.read.parquet(f"{tmp_path}/days").collect()) == [1, 2, 3, 5, 9]


def test_captures_by_the_time_in_their_names(spark):
    names = ["status_20240307T101500Z.json.gz", "status_20240307T112500Z.json.gz", "readme.txt", "status_20240307T112430Z.json"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").withColumn("at", live.captured_at(F.col("name")))
    assert {r.name: str(r.at) for r in rows.collect()}[names[2]] == "None"
    kept = live.recent(rows, "at", F.lit(datetime(2024, 3, 7, 11, 24, 30)).cast("timestamp_ntz"))
    assert [r.name for r in kept.collect()] == [names[3]] and live.recent(rows, "at", F.lit(datetime(2024, 3, 7, 11, 24, 29)).cast("timestamp_ntz")).count() == 1


def test_near_points_across_the_date_line_and_the_whole_earth(spark):
    import math

    rng = np.random.default_rng(4)
    spots = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-60, 60, 40), rng.uniform(-180, 180, 40)))] + [(100, 10.0, 179.999), (101, 10.0, -179.999), (102, 10.001, -179.9995)]

    def metres(p, q):
        a = [math.radians(x) for x in (p[1], p[2], q[1], q[2])]
        h = math.sin((a[2] - a[0]) / 2) ** 2 + math.cos(a[0]) * math.cos(a[2]) * math.sin((a[3] - a[1]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))

    frame = spark.createDataFrame(spots, "sid long, lat double, lon double")
    for reach in (500, 50_000, 2_000_000, 9_000_000, 20_100_000):
        got = S.near_points(frame.withColumnRenamed("sid", "a"), frame, reach).select("a", "b").collect()
        expected = {(p[0], q[0]) for p in spots for q in spots if metres(p, q) <= reach}
        assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_nearest_widens_in_rings(spark):
    from harborlight.plans import planner

    rng = np.random.default_rng(5)
    stations = [(i, 19.4 + float(a), -99.1 + float(b)) for i, (a, b) in enumerate(zip(rng.normal(0, 0.01, 60), rng.normal(0, 0.01, 60)))] + [(900, 40.0, -3.7)]
    asked = [(1, 19.4, -99.1, 0), (2, 19.9, -99.0, 3), (3, 41.0, -3.0, 900), (4, -40.0, 170.0, 5), (5, 40.0, -3.7, 7)]
    frame = spark.createDataFrame(stations, "station_id long, lat double, lon double")
    got = planner.nearest(spark.createDataFrame(asked, "request_id long, y double, x double, origin_id long"), frame, "y", "x", 500, 3, "origin_id")
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    far = S.near_points(spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in asked], "request_id long, lat double, lon double, origin_id long"), frame.withColumnRenamed("station_id", "sid"), 20_100_000)
    every = {}
    for r in far.where("b <> origin_id").collect():
        every.setdefault(r.request_id, []).append((r.metres * 1.3, r.b))
    found = {}
    for r in got.collect():
        found.setdefault(r.request_id, []).append((r.by_distance, r.station_id))
    for k, v in every.items():
        near = [b for m, b in sorted(v) if m <= 500]
        assert [b for _, b in sorted(found[k])] == (near if len(near) >= 3 else [b for _, b in sorted(v)[:3]])


def test_prefixes_are_sought_once_a_name_and_ids_gathered_once_an_order(spark, sf_dir):
    plan = lambda f: f(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any("Generate explode" in line and "p_partkey" in line for line in plan(city.longest_prefix).splitlines())
    assert "keys=[l_orderkey" not in plan(live.unknown_ids).replace("ObjectHashAggregate(keys=[l_orderkey", "")


def test_parts_of_a_feed_stay_whole_batches_of_several_files(spark, sf_dir, monkeypatch):
    seen = []
    parts = [spark.range(0, 90, 1, 5), spark.range(0).toDF("id"), spark.range(90, 91, 1, 1), spark.range(91, 200, 1, 3)]
    folder = jobs.in_turn(spark, parts, 4)
    assert len(spark.read.parquet(folder).inputFiles()) == 16 and jobs.files_a_batch(folder) == 4 and jobs.files_a_batch("/x/feed-1") == 1
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 4).parquet(folder)
    query = stream.writeStream.foreachBatch(lambda df, n: seen.append([r.id for r in df.collect()])).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [sorted(x) for x in seen] == [[*range(90)], [], [90], [*range(91, 200)]]
    expected = {tuple(r) for r in jobs.stream_label_join(spark, sf_dir).collect()}
    monkeypatch.setattr(jobs, "FILE_ROWS", 20)
    assert jobs.files_a_batch(jobs.in_parts(spark, sf_dir)) > 1
    assert {tuple(r) for r in jobs.stream_label_join(spark, sf_dir).collect()} == expected


def test_trip_times_are_parsed_once(spark, tmp_path):
    for month in range(1, 10):
        (tmp_path / f"2024-0{month}.csv").write_text("Bici,CE_retiro,Fecha_retiro,Hora_retiro,CE_arribo,Fecha_arribo,Hora_arribo\n1,1,03/03/24,1:02:03,2,3/3/24,2:03:04\n")
    rows = trip_files.read_months(spark, [f"{tmp_path}/2024-0{month}.csv" for month in range(1, 10)])
    assert sorted((r.month, round(r.duration_min, 4)) for r in rows.collect()) == [(f"2024-0{month}", 61.0167) for month in range(1, 10)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp(") == 2 and plan.lower().count("instr(") == 0


def test_the_matrix_reads_trips_and_events_for_what_it_joins_once(spark, sf_dir):
    plan = learning.feature_matrix(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and plan.count("Relation") <= 16  # 31 with trips, weather and places in the plan
