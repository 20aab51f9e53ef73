"""Trip plans: candidates, pickups and their ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlight.config import BIKE_KMH, DETOUR, HORIZONS, MIN_PAIR_TRIPS, PICKUP_M, PICKUPS, WALK_KMH, WALK_M
from harborlight.functions.geo import haversine_m
from harborlight.functions.prob import at_minutes, band, heuristic, ramp
from harborlight.operators import stations as S
from harborlight.plans import views_sql as V
from harborlight.plans.trips import ride_times
from harborlight.sources import tables as T
from harborlight.sources.shared import saved

R6 = lambda c: F.round(c, 6)
POINT = (19.4105, -99.1685)
FAILURE_MIN = 7.5
#: How much farther each ring reaches, and the farthest that a point can be.
RING, HALF_EARTH_M = 4.0, 20_100_000.0


def nearest(requests: DataFrame, stations: DataFrame, lat: str, lon: str, radius_m: float, least: int, barred: str | None = None) -> DataFrame:
    """The stations within a walk of each request's point, or its `least` nearest ones, with walk_m and by_distance from 1.

    Those within the radius come from a join on grid cells. Only requests that have too few there, a part of a stated
    set, look again within RING times the distance, and so on, until each has enough or the whole earth was searched.
    """
    points = requests.withColumns({"lat": F.col(lat), "lon": F.col(lon)})
    allowed = lambda rows: rows.where(F.col("station_id") != F.col(barred)) if barred else rows
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("walk_m", "station_id"))
    met = S.near_points(points, stations.withColumnRenamed("station_id", "sid"), radius_m / DETOUR * 1.0001).drop("lat", "lon")
    met = allowed(met.withColumnRenamed("b", "station_id")).withColumn("walk_m", F.col("metres") * DETOUR).where(F.col("walk_m") <= radius_m)
    met = met.select("request_id", "station_id", "walk_m")
    enough = met.groupBy("request_id").count().where(F.col("count") >= least)
    few, found, reach = saved(points.join(enough, "request_id", "left_anti")), None, radius_m
    while not few.isEmpty() and reach < HALF_EARTH_M * DETOUR:  # in rings, and only the requests that still have too few
        reach *= RING
        near = S.near_points(few, stations.withColumnRenamed("station_id", "sid"), reach / DETOUR).drop("lat", "lon")
        near = allowed(near.withColumnRenamed("b", "station_id")).withColumn("walk_m", F.col("metres") * DETOUR)
        near = near.withColumn("n", place).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("request_id")))
        whole = (F.col("all") >= least) | F.lit(reach >= HALF_EARTH_M * DETOUR)
        near = saved(near.where(whole & (F.col("n") <= least)).select("request_id", "station_id", "walk_m"))
        found = near if found is None else found.unionByName(near)
        few = saved(few.join(near.select("request_id").distinct(), "request_id", "left_anti"))
    far = met.limit(0) if found is None else found
    both = met.join(enough, "request_id", "left_semi").unionByName(far).withColumn("by_distance", place)
    return both.join(requests, "request_id").join(stations, "station_id")


def candidates(requests: DataFrame, stations: DataFrame, radius_m: float = WALK_M, least: int = 2) -> DataFrame:
    """Stations near each request's destination, without its origin: within the radius, or the nearest ones."""
    return nearest(requests, stations, "to_lat", "to_lon", radius_m, least, "origin_id").drop("by_distance")


def ranked(near: DataFrame, origins: DataFrame, rides: DataFrame, depart_after_min: float = 0.0) -> DataFrame:
    """Candidates with ride, chance and expected minutes; rank counts the recommendable ones."""
    pair = rides.select("origin_id", F.col("destination_id").alias("station_id"), F.col("ride_min").alias("usual_min"), "trips")
    o = origins.select(F.col("station_id").alias("origin_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    rows = near.join(o, "origin_id").join(pair, ["origin_id", "station_id"], "left")
    usual = F.coalesce("trips", F.lit(0)) >= MIN_PAIR_TRIPS
    straight = haversine_m(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) * DETOUR / (BIKE_KMH * 1000 / 60)
    rows = rows.withColumn("walk_min", F.col("walk_m") / (WALK_KMH * 1000 / 60)).withColumn("ride_min", F.when(usual, F.col("usual_min")).otherwise(straight))
    rows = rows.withColumn("ride_source", F.when(usual, F.format_string("median of %d trips", "trips")).otherwise(f"estimate at {BIKE_KMH:.0f} km/h"))
    rows = rows.withColumn("p_full", at_minutes(F.col("ride_min") + depart_after_min, HORIZONS, [F.col(f"p_full_{h}") for h in HORIZONS]))
    rows = rows.withColumn("expected_min", F.col("ride_min") + F.col("walk_min") + F.col("p_full") * FAILURE_MIN)
    rows = rows.withColumn("recommendable", F.col("p_full").isNotNull() & S.recommendable(F.col("label")))
    place = F.row_number().over(Window.partitionBy("request_id", "recommendable").orderBy("expected_min", "station_id"))
    return rows.withColumn("rank", F.when(F.col("recommendable"), place).cast("long"))


def pickups(requests: DataFrame, stations: DataFrame, radius_m: float = PICKUP_M, limit: int = PICKUPS) -> DataFrame:
    """Usable stations with a bike within the radius of each request's start, the nearest one always."""
    usable = stations.where(S.recommendable(F.col("label")) & (F.col("bikes") > 0))
    rows = nearest(requests, usable, "from_lat", "from_lon", radius_m, 1).where(F.col("by_distance") <= limit)
    return rows.withColumn("walk_min", F.col("walk_m") / (WALK_KMH * 1000 / 60)).withColumn("p_empty", ramp(F.col("p_empty_15"), F.col("walk_min")))


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each station with its forecasts."""
    last = Window.partitionBy("sid").orderBy(F.col("t").desc())
    rows = T.readings(spark, sf_dir).withColumn("n", F.row_number().over(last)).where("n = 1")
    k = F.col("k")
    name = S.label(F.col("ok"), F.col("age_s"), F.col("is_full")).alias("label")
    return rows.select(F.col("sid").alias("station_id"), "lat", "lon", name, "bikes", *(F.when(k % 9 != 0, ((k + h) % 100 + 0.5) / 100).cast("double").alias(f"p_full_{h}") for h in HORIZONS), ((k + 0.5) / 100).cast("double").alias("p_empty_15"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request from each customer whose number is divisible by 100."""
    i = F.col("c_custkey")
    return T.table(spark, sf_dir, "customer").where("c_custkey % 100 = 0").select(
        i.alias("request_id"), F.floor(i / 10).alias("origin_id"), (F.lit(19.40) + (i * 7 % 40) * 0.001).cast("double").alias("to_lat"), F.lit(POINT[1]).alias("to_lon"),
        (F.lit(19.40) + (i * 3 % 40) * 0.001).cast("double").alias("from_lat"), F.lit(-99.1695).alias("from_lon"),
    )


def plan_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(requests(spark, sf_dir), board(spark, sf_dir))
    return rows.select("request_id", "station_id", F.round("walk_m", 3).alias("walk_m"))


def plan_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = board(spark, sf_dir)
    rows = ranked(candidates(requests(spark, sf_dir), b), b, ride_times(spark, sf_dir))
    return rows.select("request_id", "station_id", "rank", "recommendable", "ride_source", F.round("ride_min", 5).alias("ride_min"), R6("p_full").alias("p_full"), F.round("expected_min", 5).alias("expected_min"))


def pickup_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pickups(requests(spark, sf_dir), board(spark, sf_dir))
    return rows.select("request_id", "station_id", F.round("walk_min", 5).alias("walk_min"), R6("p_empty").alias("p_empty"))


def nearest_with_bike(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pickups(requests(spark, sf_dir), board(spark, sf_dir), limit=1)
    return rows.select("request_id", "station_id", F.round("walk_m", 3).alias("walk_m"))


def best_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all pickups and drop-offs of a request the pair with the least time."""
    b, r = board(spark, sf_dir), requests(spark, sf_dir)
    from_there = pickups(r, b).select("request_id", F.col("station_id").alias("pickup_id"), F.col("walk_min").alias("first_min"))
    drops = ranked(candidates(r, b), b, ride_times(spark, sf_dir)).where("recommendable").select("request_id", "station_id", "expected_min")
    pairs = from_there.join(drops, "request_id").where("pickup_id <> station_id").withColumn("total", F.round(F.col("first_min") + F.col("expected_min"), 5))
    best = pairs.groupBy("request_id").agg(F.min(F.struct("total", "pickup_id", "station_id")).alias("m"))
    return best.select("request_id", "m.pickup_id", "m.station_id", "m.total")


def sort_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place in each of the three orders, those that can't be recommended last."""
    b = board(spark, sf_dir)
    rows = ranked(candidates(requests(spark, sf_dir), b), b, ride_times(spark, sf_dir)).withColumns({c: F.round(c, 5) for c in ("expected_min", "walk_m", "p_full")})
    place = lambda c: F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("recommendable"), F.asc_nulls_last(c), "station_id")).cast("long")
    return rows.select("request_id", "station_id", place("expected_min").alias("by_time"), place("walk_m").alias("by_walk"), place("p_full").alias("by_free"))


def p_full_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = spark.range(0, 61, 5).select(F.col("id").alias("minutes"))
    rows = board(spark, sf_dir).crossJoin(F.broadcast(minutes))
    p = at_minutes(F.col("minutes"), HORIZONS, [F.col(f"p_full_{h}") for h in HORIZONS])
    return rows.select("station_id", "minutes", R6(p).alias("p_full"), band(F.round(p, 6)).alias("shown"))


def planner_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = spark.range(0, 61, 15).select(F.col("id").alias("minutes"))
    rows = board(spark, sf_dir).crossJoin(F.broadcast(minutes))
    return rows.select("station_id", "minutes", R6(heuristic(F.col("label") == "full", F.col("p_full_15"), F.col("minutes"))).alias("p"))


QUERIES = [plan_candidates, plan_rank, pickup_options, nearest_with_bike, best_trip, sort_modes, p_full_interpolation, planner_heuristic]


def metres(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"


BOARD = """board AS (SELECT sid AS station_id, lat, lon, CASE WHEN NOT ok THEN 'unavailable' WHEN age_s > 10800 THEN 'stale' WHEN is_full THEN 'full' ELSE 'available' END AS label, bikes,
  CASE WHEN k % 9 <> 0 THEN CAST(((k + 15) % 100 + 0.5) / 100 AS DOUBLE) END AS p_full_15, CASE WHEN k % 9 <> 0 THEN CAST(((k + 30) % 100 + 0.5) / 100 AS DOUBLE) END AS p_full_30,
  CASE WHEN k % 9 <> 0 THEN CAST(((k + 45) % 100 + 0.5) / 100 AS DOUBLE) END AS p_full_45, CAST((k + 0.5) / 100 AS DOUBLE) AS p_empty_15
  FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY t DESC) AS n FROM snap) WHERE n = 1)"""
REQUESTS = f"""requests AS (SELECT c_custkey AS request_id, c_custkey // 10 AS origin_id, CAST(19.40 + (c_custkey * 7 % 40) * 0.001 AS DOUBLE) AS to_lat, CAST({POINT[1]} AS DOUBLE) AS to_lon,
  CAST(19.40 + (c_custkey * 3 % 40) * 0.001 AS DOUBLE) AS from_lat, CAST(-99.1695 AS DOUBLE) AS from_lon FROM customer WHERE c_custkey % 100 = 0)"""
NEAR = f"""near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY walk_m, station_id) AS k FROM (SELECT r.*, b.*, {metres("b.lat", "b.lon", "to_lat", "to_lon")} * 1.3::DOUBLE AS walk_m
  FROM requests r, board b WHERE station_id <> origin_id)) WHERE walk_m <= 500 OR k <= 2)"""
RIDES = """codes AS (SELECT origin_code, destination_code, median(duration_min) AS ride_min, count(*) AS trips FROM trips WHERE duration_min BETWEEN 1 AND 90 AND origin_code <> destination_code GROUP BY 1, 2),
rides AS (SELECT * FROM (SELECT CAST(origin_code AS BIGINT) // 2 AS origin_id, CAST(destination_code AS BIGINT) // 2 AS station_id, ride_min AS usual_min, trips,
  row_number() OVER (PARTITION BY CAST(origin_code AS BIGINT) // 2, CAST(destination_code AS BIGINT) // 2 ORDER BY trips DESC, origin_code, destination_code) AS z FROM codes) WHERE z = 1)"""
AT = """CASE WHEN {m} <= 15 THEN p_full_15 WHEN {m} <= 30 THEN p_full_15 + (p_full_30 - p_full_15) * ({m} - 15) / 15.0::DOUBLE WHEN {m} <= 45 THEN p_full_30 + (p_full_45 - p_full_30) * ({m} - 30) / 15.0::DOUBLE ELSE p_full_45 END"""
RANKED = f"""timed AS (SELECT n.*, CASE WHEN coalesce(trips, 0) >= 20 THEN usual_min ELSE {metres("n.lat", "n.lon", "o.lat", "o.lon")} * 1.3::DOUBLE / (12.0::DOUBLE * 1000 / 60) END AS ride_min,
  CASE WHEN coalesce(trips, 0) >= 20 THEN 'median of ' || trips || ' trips' ELSE 'estimate at 12 km/h' END AS ride_source, walk_m / (4.8::DOUBLE * 1000 / 60) AS walk_min
  FROM near n JOIN board o ON o.station_id = n.origin_id LEFT JOIN rides r ON r.origin_id = n.origin_id AND r.station_id = n.station_id),
chance AS (SELECT *, {AT.format(m="ride_min")} AS p_full FROM timed),
scored AS (SELECT *, ride_min + walk_min + p_full * 7.5::DOUBLE AS expected_min, p_full IS NOT NULL AND label IN ('available', 'full') AS recommendable FROM chance),
ranked AS (SELECT *, CASE WHEN recommendable THEN row_number() OVER (PARTITION BY request_id, recommendable ORDER BY expected_min, station_id) END AS rank FROM scored)"""
PICK = f"""pick AS (SELECT *, walk_m / (4.8::DOUBLE * 1000 / 60) AS walk_min FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY walk_m, station_id) AS k FROM (SELECT r.*, b.*, {metres("b.lat", "b.lon", "from_lat", "from_lon")} * 1.3::DOUBLE AS walk_m
  FROM requests r, board b WHERE label IN ('available', 'full') AND bikes > 0)) WHERE (walk_m <= 600 OR k = 1) AND k <= 4)"""
W = V.with_views
ALL = W(V.SNAP, BOARD, REQUESTS, NEAR, V.TRIPS, RIDES, RANKED, PICK)
SQL = {
    "plan_candidates": W(V.SNAP, BOARD, REQUESTS, NEAR) + " SELECT request_id, station_id, round(walk_m, 3) AS walk_m FROM near",
    "plan_rank": ALL + " SELECT request_id, station_id, rank, recommendable, ride_source, round(ride_min, 5) AS ride_min, round(p_full, 6) AS p_full, round(expected_min, 5) AS expected_min FROM ranked",
    "pickup_options": W(V.SNAP, BOARD, REQUESTS, PICK) + " SELECT request_id, station_id, round(walk_min, 5) AS walk_min, round(p_empty_15 * least(greatest(walk_min / 15.0::DOUBLE, 0), 1), 6) AS p_empty FROM pick",
    "nearest_with_bike": W(V.SNAP, BOARD, REQUESTS, PICK) + " SELECT request_id, station_id, round(walk_m, 3) AS walk_m FROM pick WHERE k = 1",
    "best_trip": ALL + """ SELECT request_id, pickup_id, station_id, total FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY total, pickup_id, station_id) AS z FROM (
        SELECT p.request_id, p.station_id AS pickup_id, r.station_id, round(p.walk_min + r.expected_min, 5) AS total FROM pick p JOIN ranked r ON r.request_id = p.request_id AND r.recommendable AND r.station_id <> p.station_id)) WHERE z = 1""",
    "sort_modes": ALL + " SELECT request_id, station_id, " + ", ".join(f"row_number() OVER (PARTITION BY request_id ORDER BY recommendable DESC, round({c}, 5) ASC NULLS LAST, station_id) AS {n}" for c, n in (("expected_min", "by_time"), ("walk_m", "by_walk"), ("p_full", "by_free"))) + " FROM ranked",
    "p_full_interpolation": W(V.SNAP, BOARD) + f""", p AS (SELECT station_id, minutes, round({AT.format(m="minutes")}, 6) AS p_full FROM board, (SELECT range AS minutes FROM range(0, 61, 5)))
        SELECT *, CASE WHEN p_full > 0.99 THEN '>99 %' WHEN p_full < 0.01 THEN '<1 %' ELSE CAST(CAST(round(p_full * 100) AS INT) AS VARCHAR) || ' %' END AS shown FROM p""",
    "planner_heuristic": W(V.SNAP, BOARD) + """ SELECT station_id, minutes, round(CAST(label = 'full' AS INT) * (1 - least(minutes / 45.0::DOUBLE, 1)) + p_full_15 * least(minutes / 45.0::DOUBLE, 1), 6) AS p
        FROM board, (SELECT range AS minutes FROM range(0, 61, 15))""",
}
