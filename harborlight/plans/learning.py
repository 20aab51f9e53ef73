"""Labelled examples, lags, the feature matrix, baselines and their scores. Horizons and lags are scaled to the sparse readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlight.config import HOLIDAYS, SATURATED, ZONE
from harborlight.functions import timeparts as P
from harborlight.operators import asof, metrics
from harborlight.operators import stations as S
from harborlight.plans import views_sql as V
from harborlight.plans.trips import cumulative, flow_of, plausible, window_of
from harborlight.sources import tables as T
from harborlight.sources.shared import saved

HORIZON, TOLERANCE, LAGS = 720, 360, (720, 1440, 2880)
TRAIN, FIT, REPORT = (1, 18), (19, 22), (23, 30)
MODELS = ("p_persist", "p_persist_cal", "p_hist")
R6 = lambda c: F.round(c, 6)


def arrival(horizon: int) -> dict[str, Column]:
    """The slot and the kind of day of the arrival."""
    later = P.plus_minutes(F.col("t"), horizon)
    return {"target_slot": P.slot(later), "weekend": P.is_weekend(later)}


def known_at(now: DataFrame, horizon: int) -> DataFrame:
    """What an example knows at t; the slot and the kind of day are those of the arrival."""
    return now.select("sid", "t", "d", P.slot(F.col("t")).alias("slot"), *(c.alias(n) for n, c in arrival(horizon).items()), F.col("is_full").alias("full_now"), F.col("docks").alias("docks_now"), "capacity")


def known(readings: DataFrame) -> DataFrame:
    """The same of the readings in service, without an arrival."""
    return known_at(readings.where("ok"), 0).drop("target_slot", "weekend")


def examples(readings: DataFrame, horizon: int = HORIZON, tolerance: int = TOLERANCE) -> DataFrame:
    """Readings in service with y, the state at the first reading at or after t + h - tolerance; a late or bad one drops the example."""
    now = known_at(readings.where("ok"), horizon)
    met = asof.forward(now, readings.select("sid", "t", "is_full", "ok"), ["sid"], P.plus_minutes(F.col("t"), horizon - tolerance), "t", ["is_full", "ok"])
    good = (F.col("_hit.t") <= P.plus_minutes(F.col("t"), horizon + tolerance)) & F.col("_hit.ok")
    return met.where(good).select(*now.columns, F.col("_hit.is_full").alias("y"))


def examples_now(readings: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The same columns for prediction, with y unknown."""
    return known_at(readings.where("ok"), horizon).withColumn("y", F.lit(None).cast("boolean"))


def examples_of(readings: DataFrame, horizons: tuple[int, ...], tolerance: int = TOLERANCE) -> DataFrame:
    """What examples() finds at each horizon, from one pass: known columns without those of an arrival, and y{h}, a struct of y, null where the horizon has no example."""
    now = known(readings)
    frames = {f"y{h}": (h - tolerance, h + tolerance, F.first) for h in horizons}
    met = asof.framed(now, readings, ["sid"], "t", "is_full", "ok", frames)
    met = met.withColumns({n: F.when(F.col(n).isNotNull(), F.struct(F.col(n)["_value"].alias("y"))) for n in frames})
    return met.where(F.coalesce(*(F.col(n) for n in frames)).isNotNull())


def features(readings: DataFrame, grid: DataFrame, flow: DataFrame, hourly: DataFrame, ex: DataFrame, horizon: int = HORIZON, lags: tuple[int, ...] = LAGS, tolerance: int = TOLERANCE, centered: bool = False, places: DataFrame | None = None, profile: DataFrame | None = None) -> DataFrame:
    """The examples with everything known at t: state, lags, neighbours, calendar, weather, flows and profiles of the training days.

    Where readings are a lookback only, places and profile come from a bundle.
    """
    rows = around(readings, grid, hourly, ex, S.places(readings) if places is None else places, lags, tolerance, centered)
    rows = flows(rows.withColumn("station_id", station_code()), flow).drop("station_id")
    rows = rows.join(S.profile(readings.where(F.col("d").between(*TRAIN))) if profile is None else profile, "sid", "left")
    return rows.withColumns(state() | calendar(horizon))


def around(readings: DataFrame, grid: DataFrame, hourly: DataFrame, ex: DataFrame, places: DataFrame, lags: tuple[int, ...] = LAGS, tolerance: int = TOLERANCE, centered: bool = False) -> DataFrame:
    """ex with what no horizon changes: place, state, lags, neighbours and weather."""
    now = readings.select("sid", "t", F.col("bikes").alias("bikes_now"), "docks_disabled")
    rows = ex.join(places.select("sid", "station"), "sid").join(now, ["sid", "t"])
    right = readings.withColumn("state", F.struct("docks", "is_full")).select("sid", "t", "state", "ok")
    rows = asof.lag_values(rows, right, ["sid"], "t", "state", "ok", lags, tolerance, centered, "lag")
    for lag in lags:
        s = F.col(f"lag{lag}")
        rows = rows.withColumns({f"docks_lag{lag}": s["docks"], f"docks_delta{lag}": F.col("docks_now") - s["docks"], f"full_lag{lag}": s["is_full"].cast("int")}).drop(f"lag{lag}")
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    rows = rows.withColumn("g", day(F.col("t"))).join(S.neighbour_state(S.neighbours(places), grid), ["sid", "g"], "left").drop("g")
    hour = F.date_trunc("hour", F.col("t")).cast("timestamp_ntz")
    w0 = hourly.select(F.col("hour").alias("_h0"), F.col("precip").alias("precip_now"), F.col("temp").alias("temperature_now"))
    w1 = hourly.select(F.col("hour").alias("_h1"), F.col("precip").alias("precip_next_hour"))
    rows = rows.withColumn("_h0", hour).withColumn("_h1", P.plus_minutes(hour, 60)).join(w0, "_h0", "left").join(w1, "_h1", "left").drop("_h0", "_h1")
    return rows


def station_code() -> Column:
    return F.lpad((F.col("sid") % 100).cast("string"), 3, "0")


def flows(rows: DataFrame, flow: DataFrame) -> DataFrame:
    """rows (station_id, slot, target_slot, weekend) with the flows of the arrival's slot and of the slots on the way."""
    at = flow.select("station_id", F.col("slot").alias("target_slot"), "weekend", F.col("arrivals_mean").alias("flow_arrivals_target"), F.col("departures_mean").alias("flow_departures_target"), F.col("net_flow_mean").alias("flow_net_target"))
    return window_of(cumulative(flow), rows.join(at, ["station_id", "target_slot", "weekend"], "left"), "station_id", "slot", "target_slot")


def state() -> dict[str, Column]:
    return {"occupancy_now": 1 - F.col("docks_now") / F.nullif(F.col("capacity"), F.lit(0)), "nb_n": F.coalesce("nb_n", F.lit(0)), "minute_of_day": P.minute_of_day(F.col("t"))}


def calendar(horizon: int) -> dict[str, Column]:
    later = P.plus_minutes(F.col("t"), horizon)
    return {"weekday": P.iso_weekday(later), "holiday": P.on_holiday(later, HOLIDAYS, ZONE)}


def baselines(ex: DataFrame, days: tuple[int, int] = TRAIN) -> DataFrame:
    """ex with the three baselines, fitted on some days: persistence, its calibration by station and state, and station cells.

    One aggregate with grouping sets has all five levels; a level is used from 20 (10) examples on, else the next one.
    """
    y = F.col("y").cast("double")
    tr = ex.where(F.col("d").between(*days)).select("sid", "full_now", "target_slot", "weekend", "y")
    sets = [["sid", "full_now"], ["full_now"], ["sid"], ["sid", "target_slot", "weekend"], []]
    level = F.grouping_id().alias("level")
    fitted = tr.groupingSets([[F.col(c) for c in s] for s in sets], "sid", "full_now", "target_slot", "weekend").agg(level, F.avg(y).alias("p"), F.count(F.lit(1)).alias("n"))
    bits = {c: 8 >> i for i, c in enumerate(("sid", "full_now", "target_slot", "weekend"))}
    at = lambda s: fitted.where(F.col("level") == 15 - sum(bits[c] for c in s))
    rows = ex.join(at(sets[0]).where("n >= 20").select("sid", "full_now", F.col("p").alias("_sn")), ["sid", "full_now"], "left")
    rows = rows.join(F.broadcast(at(sets[1]).select("full_now", F.col("p").alias("_gn"))), ["full_now"], "left")  # two rows
    rows = rows.join(at(sets[2]).select("sid", F.col("p").alias("_s")), ["sid"], "left")
    rows = rows.join(at(sets[3]).where("n >= 10").select("sid", "target_slot", "weekend", F.col("p").alias("_c")), ["sid", "target_slot", "weekend"], "left")
    rows = rows.join(F.broadcast(at([]).select(F.col("p").alias("_g"))), F.lit(True), "left")  # one row
    return rows.select(*ex.columns, F.col("full_now").cast("double").alias("p_persist"), F.coalesce("_sn", "_gn").alias("p_persist_cal"), F.coalesce("_c", "_s", "_g").alias("p_hist"))


def _examples(spark: SparkSession, sf_dir: str, horizon: int = HORIZON, tolerance: int = TOLERANCE) -> DataFrame:
    return examples(T.readings(spark, sf_dir), horizon, tolerance)


def examples_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir)


def examples_asof_1440(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir, 1440)


def examples_asof_2160(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir, 2160, 720)


def _lags(spark: SparkSession, sf_dir: str, centered: bool) -> DataFrame:
    r = T.readings(spark, sf_dir)
    return asof.lag_values(r.where("ok").select("sid", "t", "docks"), r.select("sid", "t", F.col("docks").alias("then"), "ok"), ["sid"], "t", "then", "ok", LAGS, TOLERANCE, centered, "docks_lag")


def lag_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lags(spark, sf_dir, False)


def lag_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lags(spark, sf_dir, True)


def lag_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: R6(F.avg(F.col(c).isNotNull().cast("int"))).alias(c)
    return _lags(spark, sf_dir, True).agg(*(share(f"docks_lag{x}") for x in LAGS), F.count(F.lit(1)).alias("n"))


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = saved(T.readings(spark, sf_dir))  # parsed once
    flow, hourly, places = saved(flow_of(plausible(spark, sf_dir))), saved(T.weather(spark, sf_dir)), saved(S.places(r))  # each is joined several times
    rows = features(r, T.last_of_day(r), flow, hourly, examples(r), places=places)
    doubles = [n for n, kind in rows.dtypes if kind == "double"]
    return rows.withColumns({c: F.round(c, 5 if c == "flow_net_window" else 7) + 0.0 for c in doubles})


def weather_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.readings(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "t").cast("timestamp_ntz"))
    return r.join(T.weather(spark, sf_dir), "hour", "left").groupBy("sid").agg(R6(F.avg("temp")).alias("temp"), F.sum("precip").alias("precip"))


def holiday_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = P.plus_minutes(F.col("t"), HORIZON)
    return T.readings(spark, sf_dir).select("sid", "t", P.iso_weekday(later).alias("weekday"), P.on_holiday(later, HOLIDAYS, ZONE).alias("holiday"))


def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = baselines(saved(_examples(spark, sf_dir)))
    return rows.select("sid", "t", "y", "p_persist", R6("p_persist_cal").alias("p_persist_cal"), R6("p_hist").alias("p_hist"))


def baseline_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = baselines(saved(_examples(spark, sf_dir)), (TRAIN[0], FIT[1]))
    return rows.where(F.col("d").between(*REPORT)).select("sid", "t", R6("p_persist_cal").alias("p_persist_cal_tvf"), R6("p_hist").alias("p_hist_tvf"))


def saturated(ex: DataFrame) -> DataFrame:
    rows = ex.where(F.col("d").between(*TRAIN)).groupBy("sid").agg(F.avg(F.col("y").cast("int")).alias("rate"), F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("rate") >= SATURATED)


def saturated_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations whose training examples are full often enough."""
    return saturated(_examples(spark, sf_dir)).select("sid", R6("rate").alias("rate"), "n")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = saved(_examples(spark, sf_dir))
    rows = baselines(ex).where(F.col("d").between(*REPORT))
    full = saturated(ex).select("sid", F.lit(True).alias("saturated"))
    rows = rows.join(full, "sid", "left").withColumn("saturated", F.coalesce("saturated", F.lit(False)))
    peak = ~F.col("weekend") & P.is_peak_slot(F.col("target_slot"))
    rows = metrics.segments(rows, {"all": F.lit(True), "peak": peak, "saturated": F.col("saturated"), "saturated_peak": F.col("saturated") & peak})
    return metrics.long_form(rows, MODELS, ["segment", "sid"])


def segment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.summarised(_scored(spark, sf_dir), ["segment", "model"])
    return rows.select("segment", "model", "n", *(R6(c).alias(c) for c in ("base_rate", "brier", "log_loss")))


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.reliability(_scored(spark, sf_dir).where("segment = 'all'"), ["model"])
    return rows.select("model", "bin", "n", R6("p_mean").alias("p_mean"), R6("y_mean").alias("y_mean"))


def calibration_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.calibration(metrics.reliability(_scored(spark, sf_dir), ["segment", "model"]), ["segment", "model"], 100)
    return rows.select("segment", "model", R6("gap").alias("gap"), R6("ece").alias("ece"))


def skill_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.summarised(_scored(spark, sf_dir), ["segment", "model"]).withColumn("brier", R6("brier"))
    return metrics.best_of(scores, ["segment"]).select("segment", "model", "best", R6("skill").alias("skill"))


def block_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared errors summed by day, which is all a bootstrap of day blocks needs."""
    rows = baselines(saved(_examples(spark, sf_dir))).where(F.col("d").between(*REPORT))
    err = lambda c: R6(F.sum(F.pow(F.col(c) - F.col("y").cast("double"), 2))).alias(c)
    return rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sid").alias("stations"), *map(err, MODELS))


def day_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 / 20 / 20 of the days in order; the window runs over days."""
    day = T.readings(spark, sf_dir).select("d").distinct()
    share = (F.row_number().over(Window.orderBy("d")) - 1) / F.count(F.lit(1)).over(Window.partitionBy())
    return day.withColumn("share", share).select("d", F.when(F.col("share") < 0.6, "train").when(F.col("share") < 0.8, "fit").otherwise("report").alias("part"))


QUERIES = [
    examples_asof, examples_asof_1440, examples_asof_2160, lag_trailing, lag_centered, lag_presence, feature_matrix, weather_join, holiday_flag, baseline_predictions,
    baseline_refit, saturated_stations, segment_metrics, reliability, calibration_gap, skill_scores, block_sums, day_split,
]

W = V.with_views


def _lag_sql(lag: int, centered: bool) -> tuple[str, str, str]:
    """Joins, and expressions for docks and for is_full."""
    at, tol = f"e.t - INTERVAL {lag} MINUTE", f"INTERVAL {TOLERANCE} MINUTE"
    joins = f" ASOF LEFT JOIN snap b{lag} ON b{lag}.sid = e.sid AND b{lag}.t <= {at}"
    back = f"coalesce(b{lag}.t >= {at} - {tol} AND b{lag}.ok, false)"
    if not centered:
        pick = lambda c: f"CASE WHEN {back} THEN b{lag}.{c} END"
    else:
        joins += f" ASOF LEFT JOIN snap a{lag} ON a{lag}.sid = e.sid AND a{lag}.t >= {at}"
        ahead = f"coalesce(a{lag}.t <= {at} + {tol} AND a{lag}.ok, false)"
        nearer = f"({back} AND (NOT {ahead} OR {at} - b{lag}.t <= a{lag}.t - ({at})))"
        pick = lambda c: f"CASE WHEN {nearer} THEN b{lag}.{c} WHEN {ahead} THEN a{lag}.{c} END"
    return joins, pick("docks"), pick("is_full")


def _lags_sql(centered: bool) -> str:
    parts = {x: _lag_sql(x, centered) for x in LAGS}
    columns = ", ".join(f"{p[1]} AS docks_lag{x}" for x, p in parts.items())
    return f" SELECT e.sid, e.t, e.docks, {columns} FROM (SELECT * FROM snap WHERE ok) e{''.join(p[0] for p in parts.values())}"


def _matrix_sql() -> str:
    parts = {x: _lag_sql(x, False) for x in LAGS}
    lagged = ", ".join(f"{d} AS docks_lag{x}, e.docks_now - {d} AS docks_delta{x}, CAST({f} AS INT) AS full_lag{x}" for x, (_, d, f) in parts.items())
    rounded = lambda c, name=None: f"round({c}, {5 if name == 'flow_net_window' else 7}) + 0.0 AS {name or c}"
    return f""" SELECT e.*, st.station, cur.bikes AS bikes_now, cur.docks_disabled, {rounded("1 - e.docks_now / nullif(e.capacity, 0)::DOUBLE", "occupancy_now")}, {lagged}, coalesce(nbf.nb_n, 0) AS nb_n,
        {rounded("nb_full_frac")}, {rounded("nb_occupancy_mean")}, nbf.nb_docks_sum, hour(e.t) * 60 + minute(e.t) AS minute_of_day, isodow(e.t + INTERVAL {HORIZON} MINUTE) AS weekday,
        CAST(e.t + INTERVAL {HORIZON} MINUTE - INTERVAL 6 HOUR AS DATE) IN ({", ".join(f"DATE '{d}'" for d in HOLIDAYS)}) AS holiday, w0.precip AS precip_now, w1.precip AS precip_next_hour, {rounded("w0.temp", "temperature_now")},
        {rounded("ft.arrivals_mean", "flow_arrivals_target")}, {rounded("ft.departures_mean", "flow_departures_target")}, {rounded("ft.net_flow_mean", "flow_net_target")},
        {rounded("coalesce(CASE WHEN e.target_slot >= e.slot THEN c1.cum_before - c0.cum_before ELSE c0.day_total - c0.cum_before + c1.cum_before END, 0)", "flow_net_window")},
        {rounded("sp.st_full_rate", "st_full_rate")}, {rounded("sp.st_peak_full_rate", "st_peak_full_rate")}
        FROM (SELECT * FROM ex) e JOIN stations st ON st.sid = e.sid JOIN snap cur ON cur.sid = e.sid AND cur.t = e.t{"".join(p[0] for p in parts.values())}
        LEFT JOIN nbf ON nbf.sid = e.sid AND nbf.g = date_trunc('day', e.t) LEFT JOIN weather w0 ON w0.hour = date_trunc('hour', e.t) LEFT JOIN weather w1 ON w1.hour = date_trunc('hour', e.t) + INTERVAL 1 HOUR
        LEFT JOIN flow ft ON ft.station_id = lpad(CAST(e.sid % 100 AS VARCHAR), 3, '0') AND ft.slot = e.target_slot AND ft.weekend = e.weekend
        LEFT JOIN flow_cum c0 ON c0.station_id = lpad(CAST(e.sid % 100 AS VARCHAR), 3, '0') AND c0.weekend = e.weekend AND c0.slot = e.slot
        LEFT JOIN flow_cum c1 ON c1.station_id = lpad(CAST(e.sid % 100 AS VARCHAR), 3, '0') AND c1.weekend = e.weekend AND c1.slot = e.target_slot LEFT JOIN profile sp ON sp.sid = e.sid"""


SCORED = """, sat AS (SELECT sid, avg(CAST(y AS INT)) AS rate FROM tr GROUP BY sid HAVING avg(CAST(y AS INT)) >= 0.1),
flagged AS (SELECT *, sid IN (SELECT sid FROM sat) AS saturated, NOT weekend AND target_slot BETWEEN 34 AND 41 AS peak FROM pred WHERE d BETWEEN 23 AND 30),
seg AS (SELECT 'all' AS segment, * FROM flagged UNION ALL SELECT 'peak', * FROM flagged WHERE peak UNION ALL SELECT 'saturated', * FROM flagged WHERE saturated
        UNION ALL SELECT 'saturated_peak', * FROM flagged WHERE saturated AND peak),
scored AS (SELECT segment, sid, y, 'p_persist' AS model, p_persist AS p FROM seg UNION ALL SELECT segment, sid, y, 'p_persist_cal', p_persist_cal FROM seg UNION ALL SELECT segment, sid, y, 'p_hist', p_hist FROM seg),
summary AS (SELECT segment, model, count(*) AS n, avg(CAST(y AS INT)) AS base_rate, avg(pow(p - CAST(y AS INT), 2)) AS brier,
            -avg(CASE WHEN y THEN ln(least(greatest(p, 1e-6), 1 - 1e-6)) ELSE ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)) END) AS log_loss FROM scored WHERE p IS NOT NULL GROUP BY 1, 2),
rel AS (SELECT segment, model, CAST(least(greatest(floor(p * 10), 0), 9) AS BIGINT) AS bin, count(*) AS n, avg(p) AS p_mean, avg(CAST(y AS INT)) AS y_mean FROM scored WHERE p IS NOT NULL GROUP BY 1, 2, 3)"""
BASE = W(V.SNAP, V.examples(), V.predictions())
SQL = {
    "examples_asof": W(V.SNAP, V.examples()) + " SELECT * FROM ex",
    "examples_asof_1440": W(V.SNAP, V.examples(1440)) + " SELECT * FROM ex",
    "examples_asof_2160": W(V.SNAP, V.examples(2160, 720)) + " SELECT * FROM ex",
    "lag_trailing": W(V.SNAP) + _lags_sql(False),
    "lag_centered": W(V.SNAP) + _lags_sql(True),
    "lag_presence": W(V.SNAP) + f" SELECT {', '.join(f'round(avg(CAST(docks_lag{x} IS NOT NULL AS INT)), 6) AS docks_lag{x}' for x in LAGS)}, count(*) AS n FROM ({_lags_sql(True)})",
    "feature_matrix": W(V.SNAP, V.GRID, V.STATIONS, V.NEIGHBOURS, V.NBF, V.PROFILE.format(where="AND d BETWEEN 1 AND 18"), V.TRIPS, V.FLOW, V.FLOW_CUM, V.WEATHER, V.examples()) + _matrix_sql(),
    "weather_join": W(V.SNAP, V.WEATHER) + " SELECT sid, round(avg(temp), 6) AS temp, CAST(sum(precip) AS BIGINT) AS precip FROM snap LEFT JOIN weather ON hour = date_trunc('hour', t) GROUP BY sid",
    "holiday_flag": W(V.SNAP) + f" SELECT sid, t, isodow(t + INTERVAL 720 MINUTE) AS weekday, CAST(t + INTERVAL 720 MINUTE - INTERVAL 6 HOUR AS DATE) IN ({', '.join(f'DATE {d!r}' for d in HOLIDAYS)}) AS holiday FROM snap",
    "baseline_predictions": BASE + " SELECT sid, t, y, p_persist, round(p_persist_cal, 6) AS p_persist_cal, round(p_hist, 6) AS p_hist FROM pred",
    "baseline_refit": W(V.SNAP, V.examples(), V.predictions(1, 22)) + " SELECT sid, t, round(p_persist_cal, 6) AS p_persist_cal_tvf, round(p_hist, 6) AS p_hist_tvf FROM pred WHERE d BETWEEN 23 AND 30",
    "saturated_stations": W(V.SNAP, V.examples()) + " SELECT sid, round(avg(CAST(y AS INT)), 6) AS rate, count(*) AS n FROM ex WHERE d BETWEEN 1 AND 18 GROUP BY sid HAVING avg(CAST(y AS INT)) >= 0.1",
    "segment_metrics": BASE + SCORED + " SELECT segment, model, n, round(base_rate, 6) AS base_rate, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss FROM summary",
    "reliability": BASE + SCORED + " SELECT model, bin, n, round(p_mean, 6) AS p_mean, round(y_mean, 6) AS y_mean FROM rel WHERE segment = 'all'",
    "calibration_gap": BASE + SCORED + " SELECT segment, model, round(max(abs(y_mean - p_mean)) FILTER (n >= 100), 6) AS gap, round(sum(abs(y_mean - p_mean) * n) / sum(n), 6) AS ece FROM rel GROUP BY 1, 2",
    "skill_scores": BASE + SCORED + """, r AS (SELECT segment, model, round(brier, 6) AS brier FROM summary), b AS (SELECT segment, model AS best, brier AS best_brier FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY brier, model) AS k FROM r) WHERE k = 1)
        SELECT segment, model, best, round(CASE WHEN best_brier > 0 THEN 1 - brier / best_brier END, 6) AS skill FROM r JOIN b USING (segment)""",
    "block_sums": BASE + " SELECT d, count(*) AS n, count(DISTINCT sid) AS stations, " + ", ".join(f"round(sum(pow({m} - CAST(y AS INT), 2)), 6) AS {m}" for m in MODELS) + " FROM pred WHERE d BETWEEN 23 AND 30 GROUP BY d",
    "day_split": W(V.SNAP) + " SELECT d, CASE WHEN s < 0.6 THEN 'train' WHEN s < 0.8 THEN 'fit' ELSE 'report' END AS part FROM (SELECT d, (row_number() OVER (ORDER BY d) - 1) / count(*) OVER () AS s FROM (SELECT DISTINCT d FROM snap))",
}
