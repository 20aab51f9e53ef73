"""Trip flows, durations and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlight.config import MAX_TRIP_MIN
from harborlight.functions import text as X
from harborlight.functions.timeparts import is_weekend, slot
from harborlight.plans import views_sql as V
from harborlight.sources import tables as T

R6 = lambda c: F.round(c, 6)


def flow_of(trips: DataFrame) -> DataFrame:
    """Mean arrivals, departures and net flow by station, slot and kind of day; the days are all of that kind, not a station's own."""
    move = lambda code, t, arr, dep: trips.select(F.col(code).alias("station_id"), F.to_date(t).alias("day"), slot(F.col(t)).alias("slot"), F.lit(arr).alias("arr"), F.lit(dep).alias("dep"))
    moves = move("destination_code", "arrived_at", 1, 0).unionByName(move("origin_code", "departed_at", 0, 1)).withColumn("weekend", is_weekend(F.col("day")))
    days = moves.groupBy("weekend").agg(F.countDistinct("day").alias("n_days"))
    sums = moves.groupBy("station_id", "slot", "weekend").agg(F.sum("arr").alias("arr"), F.sum("dep").alias("dep")).join(F.broadcast(days), "weekend")  # two rows
    a, d, n = F.col("arr"), F.col("dep"), F.col("n_days")
    return sums.select("station_id", "slot", "weekend", (a / n).alias("arrivals_mean"), (d / n).alias("departures_mean"), ((a - d) / n).alias("net_flow_mean"))


def plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.trips(spark, sf_dir).where(F.col("duration_min").between(5, 45))


def cumulative(flow: DataFrame) -> DataFrame:
    """Net flow before each of the 96 slots, and of the whole day: a window over slots becomes two lookups."""
    keys = flow.select("station_id", "weekend").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(95)))).withColumn("slot", F.col("slot").cast("long"))
    net = keys.join(flow, ["station_id", "weekend", "slot"], "left").select("station_id", "weekend", "slot", F.coalesce("net_flow_mean", F.lit(0.0)).alias("net"))
    day = Window.partitionBy("station_id", "weekend")
    before = F.sum("net").over(day.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    return net.select("station_id", "weekend", "slot", F.coalesce(before, F.lit(0.0)).alias("cum_before"), F.sum("net").over(day).alias("day_total"))


def net_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flow_of(plausible(spark, sf_dir))
    return rows.select("station_id", "slot", "weekend", *(R6(c).alias(c) for c in ("arrivals_mean", "departures_mean", "net_flow_mean")))


def flow_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cumulative(flow_of(plausible(spark, sf_dir)))
    return rows.select("station_id", "weekend", "slot", (F.round("cum_before", 5) + 0.0).alias("cum_before"), (F.round("day_total", 5) + 0.0).alias("day_total"))


def window_of(cum: DataFrame, rows: DataFrame, station: str, start: str, end: str) -> DataFrame:
    """rows with flow_net_window: net flow of the slots from start to end, around midnight if end is before start; 0 if unknown."""
    side = lambda n, s: cum.select(F.col("station_id").alias(station), "weekend", F.col("slot").alias(s), F.col("cum_before").alias(f"_c{n}"), F.col("day_total").alias(f"_t{n}"))
    both = rows.join(side(0, start), [station, "weekend", start], "left").join(side(1, end).drop("_t1"), [station, "weekend", end], "left")
    value = F.when(F.col(end) >= F.col(start), F.col("_c1") - F.col("_c0")).otherwise(F.col("_t0") - F.col("_c0") + F.col("_c1"))
    return both.withColumn("flow_net_window", F.coalesce(value, F.lit(0.0))).drop("_c0", "_t0", "_c1")


def flow_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = flow_of(plausible(spark, sf_dir))
    asked = flow.select("station_id", "weekend", F.col("slot").alias("from_slot"), F.pmod(F.col("slot") + 20, F.lit(96)).alias("to_slot"))
    rows = window_of(cumulative(flow), asked, "station_id", "from_slot", "to_slot")
    return rows.select("station_id", "weekend", "from_slot", "to_slot", (F.round("flow_net_window", 5) + 0.0).alias("flow_net_window"))


def pair_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plausible(spark, sf_dir).where("origin_code <> destination_code")
    rows = rows.groupBy("origin_code", "destination_code", F.hour("departed_at").cast("long").alias("hour")).agg(
        F.count(F.lit(1)).alias("n_trips"), F.median("duration_min").alias("duration_median"), F.percentile("duration_min", F.lit(0.75)).alias("duration_p75")
    )
    return rows.where("n_trips >= 2")


def ride_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median minutes by station pair; of the code pairs of one station pair the busiest one."""
    rows = T.trips(spark, sf_dir).where(F.col("duration_min").between(1, MAX_TRIP_MIN) & (F.col("origin_code") != F.col("destination_code")))
    by_code = rows.groupBy("origin_code", "destination_code").agg(F.median("duration_min").alias("ride_min"), F.count(F.lit(1)).alias("trips"))
    half = lambda c: F.floor(F.col(c).cast("int") / 2).cast("long")  # noqa: E731  two codes a station
    pairs = by_code.withColumn("origin_id", half("origin_code")).withColumn("destination_id", half("destination_code"))
    first = F.min(F.struct((-F.col("trips")).alias("fewer"), "origin_code", "destination_code", "ride_min", "trips")).alias("m")
    return pairs.groupBy("origin_id", "destination_id").agg(first).select("origin_id", "destination_id", "m.ride_min", "m.trips")


def trip_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lambda c: R6(F.avg(F.coalesce(c, F.lit(False)).cast("int")))
    rows = T.trips(spark, sf_dir)
    return rows.groupBy(F.date_format("departed_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), rate(F.col("duration_min").between(5, 45)).alias("plausible"), rate(F.col("origin_code") == F.col("destination_code")).alias("round_trip"),
        rate(F.col("arrived_at") < F.col("departed_at")).alias("backwards"),
    )


def station_code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paired code serves for itself and its halves; the first station with a code keeps it."""
    names = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station_id"), F.concat_ws("-", (F.col("s_suppkey") % 30).cast("string"), (F.col("s_suppkey") % 7 + 100).cast("string")).alias("code"))
    codes = names.select("station_id", F.explode(X.code_parts(F.col("code"))).alias("code"))
    return codes.groupBy("code").agg(F.min("station_id").alias("station_id"))


def union_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.trips(spark, sf_dir)
    both = t.select(F.col("origin_code").alias("code"), F.lit("out").alias("kind")).unionByName(t.select(F.col("destination_code").alias("code"), F.lit("in").alias("kind")))
    return both.groupBy("code", "kind").agg(F.count(F.lit(1)).alias("n"))


def distinct_day_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = T.trips(spark, sf_dir).select(F.to_date("departed_at").alias("day")).distinct()
    return day.groupBy(is_weekend(F.col("day")).alias("weekend")).agg(F.count(F.lit(1)).alias("n_days"))


def trip_csv_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and dates as trip files write them, read back."""
    rows = T.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit(' "'), (F.col("o_custkey") % 1200).cast("string"), F.lit('" ')).alias("raw"), F.date_format("o_orderdate", "d/M/yyyy").alias("date"),
        F.concat((F.col("o_orderkey") % 24).cast("string"), F.lit(":05:09")).alias("time"),
    )
    when = F.try_to_timestamp(F.concat_ws(" ", "date", F.lpad("time", 8, "0")), F.lit("d/M/yyyy HH:mm:ss")).cast("timestamp_ntz")
    return rows.select("o_orderkey", X.station_code(F.col("raw")).alias("code"), when.alias("departed_at"))


def route_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated against recorded minutes by origin."""
    t = plausible(spark, sf_dir).withColumn("est", F.abs(F.col("origin_code").cast("int") - F.col("destination_code").cast("int")) * 0.4 + 5.0)
    err = F.abs(F.col("est") - F.col("duration_min"))
    return t.groupBy("origin_code").agg(
        F.count(F.lit(1)).alias("n"), R6(F.median(err)).alias("median"), R6(F.percentile(err, F.lit(0.75))).alias("p75"), R6(F.percentile(err, F.lit(0.9))).alias("p90"),
        R6(F.sum(err * F.col("duration_min")) / F.sum("duration_min")).alias("weighted"), R6(F.corr("est", "duration_min")).alias("corr"),
    )


def distance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.abs(F.col("origin_code").cast("int") - F.col("destination_code").cast("int"))
    name = F.when(gap < 10, "under 10").when(gap < 30, "10 to 29").when(gap < 60, "30 to 59").otherwise("60 and over")
    return plausible(spark, sf_dir).groupBy(name.alias("band")).agg(F.count(F.lit(1)).alias("n"), R6(F.avg("duration_min")).alias("mean_min"), R6(F.percentile("duration_min", F.lit(0.5))).alias("p50"), R6(F.percentile("duration_min", F.lit(0.95))).alias("p95"))


QUERIES = [net_flow, flow_prefix_sum, flow_window, pair_duration, ride_times, trip_quality, station_code_map, union_events, distinct_day_types, trip_csv_normalise, route_error_summary, distance_bands]
W, OK = V.with_views, "duration_min BETWEEN 5 AND 45"
GAP = "abs(CAST(origin_code AS INT) - CAST(destination_code AS INT))"
SQL = {
    "net_flow": W(V.TRIPS, V.FLOW) + " SELECT station_id, slot, weekend, round(arrivals_mean, 6) AS arrivals_mean, round(departures_mean, 6) AS departures_mean, round(net_flow_mean, 6) AS net_flow_mean FROM flow",
    "flow_prefix_sum": W(V.TRIPS, V.FLOW, V.FLOW_CUM) + " SELECT station_id, weekend, slot, round(cum_before, 5) + 0.0 AS cum_before, round(day_total, 5) + 0.0 AS day_total FROM flow_cum",
    "flow_window": W(V.TRIPS, V.FLOW) + """, q AS (SELECT station_id, weekend, slot AS from_slot, (slot + 20) % 96 AS to_slot FROM flow)
        SELECT q.*, round(coalesce((SELECT sum(f.net_flow_mean) FROM flow f WHERE f.station_id = q.station_id AND f.weekend = q.weekend AND
        CASE WHEN to_slot >= from_slot THEN f.slot >= from_slot AND f.slot < to_slot ELSE f.slot >= from_slot OR f.slot < to_slot END), 0), 5) + 0.0 AS flow_net_window FROM q""",
    "pair_duration": W(V.TRIPS) + f" SELECT origin_code, destination_code, hour(departed_at) AS hour, count(*) AS n_trips, median(duration_min) AS duration_median, quantile_cont(duration_min, 0.75) AS duration_p75 FROM trips WHERE {OK} AND origin_code <> destination_code GROUP BY 1, 2, 3 HAVING count(*) >= 2",
    "ride_times": W(V.TRIPS) + """, c AS (SELECT origin_code, destination_code, median(duration_min) AS ride_min, count(*) AS trips FROM trips WHERE duration_min BETWEEN 1 AND 90 AND origin_code <> destination_code GROUP BY 1, 2),
        r AS (SELECT CAST(origin_code AS BIGINT) // 2 AS origin_id, CAST(destination_code AS BIGINT) // 2 AS destination_id, ride_min, trips,
        row_number() OVER (PARTITION BY CAST(origin_code AS BIGINT) // 2, CAST(destination_code AS BIGINT) // 2 ORDER BY trips DESC, origin_code, destination_code) AS n FROM c)
        SELECT origin_id, destination_id, ride_min, trips FROM r WHERE n = 1""",
    "trip_quality": W(V.TRIPS) + f" SELECT strftime(departed_at, '%Y-%m') AS month, count(*) AS n, round(avg(CAST({OK} AS INT)), 6) AS plausible, round(avg(CAST(origin_code = destination_code AS INT)), 6) AS round_trip, round(avg(CAST(arrived_at < departed_at AS INT)), 6) AS backwards FROM trips GROUP BY 1",
    "station_code_map": """WITH n AS (SELECT s_suppkey AS station_id, CAST(s_suppkey % 30 AS VARCHAR) AS a, CAST(s_suppkey % 7 + 100 AS VARCHAR) AS b FROM supplier),
        c AS (SELECT station_id, a || '-' || b AS code FROM n UNION ALL SELECT station_id, a FROM n UNION ALL SELECT station_id, b FROM n) SELECT code, min(station_id) AS station_id FROM c GROUP BY code""",
    "union_events": W(V.TRIPS) + " SELECT code, kind, count(*) AS n FROM (SELECT origin_code AS code, 'out' AS kind FROM trips UNION ALL SELECT destination_code, 'in' FROM trips) GROUP BY 1, 2",
    "distinct_day_types": W(V.TRIPS) + " SELECT isodow(CAST(departed_at AS DATE)) >= 6 AS weekend, count(DISTINCT CAST(departed_at AS DATE)) AS n_days FROM trips GROUP BY 1",
    "trip_csv_normalise": """SELECT o_orderkey, CASE WHEN o_custkey % 1200 < 100 THEN lpad(CAST(o_custkey % 1200 AS VARCHAR), 3, '0') ELSE CAST(o_custkey % 1200 AS VARCHAR) END AS code,
        date_trunc('day', o_orderdate) + to_hours(CAST(o_orderkey % 24 AS BIGINT)) + INTERVAL 5 MINUTE + INTERVAL 9 SECOND AS departed_at FROM orders""",
    "route_error_summary": W(V.TRIPS) + f""", e AS (SELECT *, {GAP} * 0.4::DOUBLE + 5.0::DOUBLE AS est FROM trips WHERE {OK}), f AS (SELECT *, abs(est - duration_min) AS err FROM e)
        SELECT origin_code, count(*) AS n, round(median(err), 6) AS median, round(quantile_cont(err, 0.75), 6) AS p75, round(quantile_cont(err, 0.9), 6) AS p90, round(sum(err * duration_min) / sum(duration_min), 6) AS weighted, round(corr(est, duration_min), 6) AS corr FROM f GROUP BY 1""",
    "distance_bands": W(V.TRIPS) + f""" SELECT CASE WHEN {GAP} < 10 THEN 'under 10' WHEN {GAP} < 30 THEN '10 to 29' WHEN {GAP} < 60 THEN '30 to 59' ELSE '60 and over' END AS band, count(*) AS n, round(avg(duration_min), 6) AS mean_min,
        round(quantile_cont(duration_min, 0.5), 6) AS p50, round(quantile_cont(duration_min, 0.95), 6) AS p95 FROM trips WHERE {OK} GROUP BY 1""",
}
