"""Saturation, neighbours, coverage and capture reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlight.config import SATURATED
from harborlight.functions.timeparts import is_peak, is_weekend, minute_of_day, slot
from harborlight.operators import stations as S
from harborlight.plans import views_sql as V
from harborlight.plans.trips import flow_of, plausible
from harborlight.sources import tables as T

R6 = lambda c: F.round(c, 6)


def full() -> Column:
    return F.col("is_full").cast("int")


def saturation_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour, weekend = F.hour("t").cast("long").alias("hour"), is_weekend(F.col("t")).alias("weekend")
    return T.readings(spark, sf_dir).where("ok").groupBy(hour, weekend).agg(R6(F.avg(full())).alias("full_rate"), F.count(F.lit(1)).alias("n"))


def saturation_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.readings(spark, sf_dir).where("ok").agg(
        R6(F.avg(full())).alias("full_rate"), R6(F.avg(F.when(is_peak(F.col("t")), full()))).alias("peak_rate"), F.count(F.lit(1)).alias("n"), F.countDistinct("sid").alias("stations")
    )


def saturation_peak_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.col("st_peak_full_rate")
    some = [F.count_if(rate >= x).alias(f"at_{int(x * 100)}") for x in (0.10, 0.25, 0.50)]
    return S.profile(T.readings(spark, sf_dir)).where(rate.isNotNull()).agg(F.count(F.lit(1)).alias("stations"), *some)


def saturation_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.profile(T.readings(spark, sf_dir)).select("sid", R6("st_full_rate").alias("rate"))
    return rows.orderBy(F.desc("rate"), "sid").limit(10)


def neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.neighbours(S.places(T.readings(spark, sf_dir))).select("a", "b", F.round("metres", 3).alias("metres"))


def neighbour_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = S.neighbours(S.places(T.readings(spark, sf_dir)))
    rows = S.neighbour_state(edges, T.daily_readings(spark, sf_dir))
    return rows.select("sid", "g", "nb_n", R6("nb_full_frac").alias("nb_full_frac"), R6("nb_occupancy_mean").alias("nb_occupancy_mean"), "nb_docks_sum")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stations of each edge at the same shared time, in service."""
    grid = T.daily_readings(spark, sf_dir).where("ok")
    edges = S.neighbours(S.places(T.readings(spark, sf_dir)))
    one = grid.select(F.col("sid").alias("a"), "g", F.col("is_full").alias("full_a"))
    other = grid.select(F.col("sid").alias("b"), "g", F.col("is_full").alias("full_b"))
    return edges.join(one, "a").join(other, ["b", "g"])


def neighbour_conditional_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.when(F.col("metres") <= 150, "near").otherwise("far").alias("band")
    full = F.col("full_b").cast("int")
    return _pairs(spark, sf_dir).groupBy(near).agg(
        R6(F.avg(full)).alias("p_full"), R6(F.avg(F.when(F.col("full_a"), full))).alias("p_full_given_full"), F.count_if("full_a").alias("n_full"), F.count(F.lit(1)).alias("n")
    )


def neighbour_all_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _pairs(spark, sf_dir).where("full_a").groupBy("a", "g").agg(F.bool_and("full_b").alias("every"), F.bool_or("full_b").alias("some"))
    return at.agg(R6(F.avg(F.col("every").cast("int"))).alias("all_full"), R6(F.avg(F.col("some").cast("int"))).alias("any_full"), F.countDistinct("a").alias("stations"), F.count(F.lit(1)).alias("n"))


def station_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.profile(T.readings(spark, sf_dir)).select("sid", R6("st_full_rate").alias("st_full_rate"), R6("st_peak_full_rate").alias("st_peak_full_rate"))


def station_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.places(T.readings(spark, sf_dir)).select("sid", "station", R6("lat").alias("lat"), R6("lon").alias("lon"))


def demand_weighted_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = T.readings(spark, sf_dir).where("ok").groupBy(
        F.lpad((F.col("sid") % 100).cast("string"), 3, "0").alias("station_id"), is_weekend(F.col("t")).alias("weekend"), slot(F.col("t")).alias("slot")
    ).agg(F.avg(full()).alias("f"))
    j = slots.join(flow_of(plausible(spark, sf_dir)), ["station_id", "slot", "weekend"])
    w = F.col("arrivals_mean")
    peak = ~F.col("weekend") & F.col("slot").between(34, 41)
    part = lambda c: F.sum(F.when(peak, c))
    return j.agg(
        R6(F.sum(F.col("f") * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("overall"), R6(part(F.col("f") * w) / F.nullif(part(w), F.lit(0.0))).alias("weekday_peak"),
        F.countDistinct("station_id").alias("stations"),
    )


def month_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.gaps(T.readings(spark, sf_dir)).withColumn("month", F.date_format("t", "yyyy-MM"))
    minutes = F.coalesce(F.sum(F.when(F.col("gap_min") <= 30, F.col("gap_min"))), F.lit(0.0))
    rows = t.groupBy("month").agg(
        F.count(F.lit(1)).alias("n"), F.median("gap_min").alias("median"), F.percentile("gap_min", F.lit(0.95)).alias("p95"), F.max("gap_min").alias("longest"),
        minutes.alias("covered"), F.max(F.day(F.last_day("t"))).alias("days"),
    )
    return rows.select("month", "n", R6("median").alias("median_gap"), R6("p95").alias("p95_gap"), R6("longest").alias("max_gap"), R6(F.col("covered") / (F.col("days") * 1440)).alias("coverage"))


def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cadence = 2.5 * 15
    return S.gaps(T.readings(spark, sf_dir)).where(F.col("gap_min") > cadence).select("t", R6("gap_min").alias("gap_min")).orderBy(F.desc("gap_min"), "t").limit(20)


def label_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = S.label(F.col("ok"), F.col("age_s"), F.col("is_full")).alias("label")
    return T.readings(spark, sf_dir).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def recommendable_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = S.label(F.col("ok"), F.col("age_s"), F.col("is_full"))
    return T.readings(spark, sf_dir).groupBy("d").agg(R6(F.avg(S.recommendable(name).cast("int"))).alias("share"), F.count(F.lit(1)).alias("n"))


def silence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.col("age_s")
    name = F.when(age < 600, "under 10 min").when(age < 3600, "under 1 h").when(age <= 10800, "under 3 h").otherwise("stale")
    return T.readings(spark, sf_dir).groupBy(name.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sid").alias("stations"))


def capture_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.readings(spark, sf_dir).groupBy("d").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct("sid", "t")).alias("repeated"), F.countDistinct(F.hour("t")).alias("hours"), F.countDistinct("sid").alias("stations")
    )


def morning_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working-day mornings from 07:00 to 11:00, also those without any reading."""
    span = T.readings(spark, sf_dir).agg(F.to_date(F.min("t")).alias("a"), F.to_date(F.max("t")).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day")).where(~is_weekend(F.col("day")))
    morning = minute_of_day(F.col("t")).between(420, 659)
    seen = T.readings(spark, sf_dir).where(morning).groupBy(F.to_date("t").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(slot(F.col("t"))).alias("slots"))
    return days.join(seen, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), R6(F.coalesce("slots", F.lit(0)) / 16).alias("share"))


def captures_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.exploded(T.captures(spark, sf_dir))
    return rows.select("last_updated", "station_id", F.col("num_docks_available").alias("docks"), F.col("num_bikes_available").alias("bikes"), "is_returning", "last_reported", "num_docks_disabled")


def station_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station over the captures, with its label."""
    rows = T.exploded(T.captures(spark, sf_dir)).where("station_id = '7'")
    serves = (F.col("is_installed") == 1) & (F.col("is_returning") == 1)
    name = S.label(serves, F.col("last_updated") - F.col("last_reported"), F.col("num_docks_available") == 0)
    return rows.select("last_updated", F.col("num_docks_available").alias("docks"), F.col("num_bikes_available").alias("bikes"), name.alias("label"))


def unpivot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = T.readings(spark, sf_dir).groupBy("d").agg(F.sum("docks").alias("docks"), F.sum("bikes").alias("bikes"), F.sum("docks_disabled").alias("docks_disabled"))
    return day.unpivot("d", ["docks", "bikes", "docks_disabled"], "series", "total")


def daily_snapshot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.daily_readings(spark, sf_dir).where(F.col("age_s") <= 10_800)
    return rows.select("sid", "g", "docks", "bikes", "ok")


def source_priority_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures win over history at the same station and time."""
    rows = T.readings(spark, sf_dir).select("sid", F.date_trunc("hour", "t").cast("timestamp_ntz").alias("hour"), "docks", "t")
    both = rows.where("docks % 2 = 0").withColumn("source", F.lit(0)).unionByName(rows.withColumn("source", F.lit(1)))
    first = Window.partitionBy("sid", "hour").orderBy("source", "t")
    return both.withColumn("n", F.row_number().over(first)).where("n = 1").select("sid", "hour", "docks", F.col("source").cast("long").alias("source"))


def unseen_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.readings(spark, sf_dir)
    return r.where("d > 2").select("sid").distinct().join(r.where("d <= 2").select("sid"), "sid", "left_anti")


def center_periphery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a station lies within the median distance from the centroid."""
    st = S.places(T.readings(spark, sf_dir))
    middle = st.agg(F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon"))
    d2 = F.pow(F.col("lat") - F.col("mlat"), 2) + F.pow((F.col("lon") - F.col("mlon")) * 0.94, 2)
    far = st.crossJoin(F.broadcast(middle)).select("sid", F.round(d2, 12).alias("d2"))  # one row
    half = far.agg(F.median("d2").alias("half"))
    return far.crossJoin(F.broadcast(half)).select("sid", (F.col("d2") <= F.col("half")).alias("center"))


def saturated_station_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.readings(spark, sf_dir).where("ok and d <= 18").groupBy("sid").agg(F.avg(full()).alias("rate"), F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("rate") >= SATURATED).select("sid", R6("rate").alias("rate"), "n")


QUERIES = [
    saturation_by_hour, saturation_overall, saturation_peak_counts, saturation_top_k, neighbour_graph, neighbour_state, neighbour_conditional_full,
    neighbour_all_any, station_profile, station_codes, demand_weighted_rate, month_diagnostics, gap_report, label_mix, recommendable_share, silence_buckets,
    capture_coverage, morning_coverage, captures_explode, station_history, unpivot_series, daily_snapshot_dedup, source_priority_dedup, unseen_stations,
    center_periphery, saturated_station_share,
]

W = V.with_views
LABEL = "CASE WHEN NOT ok THEN 'unavailable' WHEN age_s > 10800 THEN 'stale' WHEN is_full THEN 'full' ELSE 'available' END"
PAIRS = """pairs AS (SELECT nb.a, nb.b, nb.metres, x.g, x.is_full AS full_a, y.is_full AS full_b FROM nb JOIN snap_grid x ON x.sid = a AND x.ok
  JOIN snap_grid y ON y.sid = b AND y.g = x.g AND y.ok)"""
GAPS = "gaps AS (SELECT t, (epoch_us(t) - epoch_us(lag(t) OVER (ORDER BY t))) / 60e6 AS gap_min FROM (SELECT DISTINCT t FROM snap))"
DOC = "docs AS (SELECT *, epoch(g)::BIGINT + 86400 AS last_updated FROM snap_grid)"
SQL = {
    "saturation_by_hour": W(V.SNAP) + " SELECT hour(t) AS hour, isodow(t) >= 6 AS weekend, round(avg(CAST(is_full AS INT)), 6) AS full_rate, count(*) AS n FROM snap WHERE ok GROUP BY 1, 2",
    "saturation_overall": W(V.SNAP) + """ SELECT round(avg(CAST(is_full AS INT)), 6) AS full_rate,
        round(avg(CAST(is_full AS INT)) FILTER (WHERE isodow(t) < 6 AND hour(t) * 60 + minute(t) BETWEEN 510 AND 630), 6) AS peak_rate, count(*) AS n, count(DISTINCT sid) AS stations FROM snap WHERE ok""",
    "saturation_peak_counts": W(V.SNAP, V.PROFILE.format(where="")) + """ SELECT count(*) AS stations, count(*) FILTER (st_peak_full_rate >= 0.1) AS at_10,
        count(*) FILTER (st_peak_full_rate >= 0.25) AS at_25, count(*) FILTER (st_peak_full_rate >= 0.5) AS at_50 FROM profile WHERE st_peak_full_rate IS NOT NULL""",
    "saturation_top_k": W(V.SNAP, V.PROFILE.format(where="")) + " SELECT sid, round(st_full_rate, 6) AS rate FROM profile ORDER BY rate DESC, sid LIMIT 10",
    "neighbour_graph": W(V.SNAP, V.STATIONS, V.NEIGHBOURS) + " SELECT a, b, round(metres, 3) AS metres FROM nb",
    "neighbour_state": W(V.SNAP, V.GRID, V.STATIONS, V.NEIGHBOURS, V.NBF) + " SELECT sid, g, nb_n, round(nb_full_frac, 6) AS nb_full_frac, round(nb_occupancy_mean, 6) AS nb_occupancy_mean, nb_docks_sum FROM nbf",
    "neighbour_conditional_full": W(V.SNAP, V.GRID, V.STATIONS, V.NEIGHBOURS, PAIRS) + """ SELECT CASE WHEN metres <= 150 THEN 'near' ELSE 'far' END AS band,
        round(avg(CAST(full_b AS INT)), 6) AS p_full, round(avg(CAST(full_b AS INT)) FILTER (full_a), 6) AS p_full_given_full, count(*) FILTER (full_a) AS n_full, count(*) AS n FROM pairs GROUP BY 1""",
    "neighbour_all_any": W(V.SNAP, V.GRID, V.STATIONS, V.NEIGHBOURS, PAIRS) + """ SELECT round(avg(CAST(e AS INT)), 6) AS all_full, round(avg(CAST(s AS INT)), 6) AS any_full, count(DISTINCT a) AS stations, count(*) AS n
        FROM (SELECT a, g, bool_and(full_b) AS e, bool_or(full_b) AS s FROM pairs WHERE full_a GROUP BY a, g)""",
    "station_profile": W(V.SNAP, V.PROFILE.format(where="")) + " SELECT sid, round(st_full_rate, 6) AS st_full_rate, round(st_peak_full_rate, 6) AS st_peak_full_rate FROM profile",
    "station_codes": W(V.SNAP, V.STATIONS) + " SELECT sid, station, round(lat, 6) AS lat, round(lon, 6) AS lon FROM stations",
    "demand_weighted_rate": W(V.SNAP, V.TRIPS, V.FLOW) + """, s AS (SELECT lpad(CAST(sid % 100 AS VARCHAR), 3, '0') AS station_id, isodow(t) >= 6 AS weekend, (hour(t) * 60 + minute(t)) // 15 AS slot, avg(CAST(is_full AS INT)) AS f
        FROM snap WHERE ok GROUP BY ALL), j AS (SELECT * FROM s JOIN flow USING (station_id, slot, weekend))
        SELECT round(sum(f * arrivals_mean) / sum(arrivals_mean), 6) AS overall, round(sum(f * arrivals_mean) FILTER (NOT weekend AND slot BETWEEN 34 AND 41) /
        sum(arrivals_mean) FILTER (NOT weekend AND slot BETWEEN 34 AND 41), 6) AS weekday_peak, count(DISTINCT station_id) AS stations FROM j""",
    "month_diagnostics": W(V.SNAP, GAPS) + """ SELECT strftime(t, '%Y-%m') AS month, count(*) AS n, round(median(gap_min), 6) AS median_gap, round(quantile_cont(gap_min, 0.95), 6) AS p95_gap, round(max(gap_min), 6) AS max_gap,
        round(coalesce(sum(gap_min) FILTER (gap_min <= 30), 0) / (max(day(last_day(t))) * 1440), 6) AS coverage FROM gaps GROUP BY 1""",
    "gap_report": W(V.SNAP, GAPS) + " SELECT t, round(gap_min, 6) AS gap_min FROM gaps WHERE gap_min > 37.5 ORDER BY gap_min DESC, t LIMIT 20",
    "label_mix": W(V.SNAP) + f" SELECT {LABEL} AS label, count(*) AS n FROM snap GROUP BY 1",
    "recommendable_share": W(V.SNAP) + f" SELECT d, round(avg(CAST(({LABEL}) IN ('available', 'full') AS INT)), 6) AS share, count(*) AS n FROM snap GROUP BY 1",
    "silence_buckets": W(V.SNAP) + """ SELECT CASE WHEN age_s < 600 THEN 'under 10 min' WHEN age_s < 3600 THEN 'under 1 h' WHEN age_s <= 10800 THEN 'under 3 h' ELSE 'stale' END AS bucket,
        count(*) AS n, count(DISTINCT sid) AS stations FROM snap GROUP BY 1""",
    "capture_coverage": W(V.SNAP) + " SELECT d, count(*) AS n, count(*) - count(DISTINCT (sid, t)) AS repeated, count(DISTINCT hour(t)) AS hours, count(DISTINCT sid) AS stations FROM snap GROUP BY 1",
    "morning_coverage": W(V.SNAP) + """ SELECT CAST(x.day AS DATE) AS day, count(sid) AS n, round(count(DISTINCT (hour(t) * 60 + minute(t)) // 15) / 16.0, 6)::DOUBLE AS share
        FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS day FROM (SELECT CAST(min(t) AS DATE) AS a, CAST(max(t) AS DATE) AS b FROM snap)) x
        LEFT JOIN snap ON CAST(t AS DATE) = x.day AND hour(t) * 60 + minute(t) BETWEEN 420 AND 659 WHERE isodow(x.day) < 6 GROUP BY 1""",
    "captures_explode": W(V.SNAP, V.GRID, DOC) + """ SELECT last_updated, CAST(sid AS VARCHAR) AS station_id, CAST(docks AS BIGINT) AS docks, CAST(bikes AS BIGINT) AS bikes, CAST(ok AS BIGINT) AS is_returning,
        CAST(floor(epoch_us(t) / 1000000) AS BIGINT) AS last_reported, CAST(NULL AS BIGINT) AS num_docks_disabled FROM docs""",
    "station_history": W(V.SNAP, V.GRID, DOC) + """ SELECT last_updated, CAST(docks AS BIGINT) AS docks, CAST(bikes AS BIGINT) AS bikes, CASE WHEN NOT ok THEN 'unavailable'
        WHEN last_updated - CAST(floor(epoch_us(t) / 1000000) AS BIGINT) > 10800 THEN 'stale' WHEN docks = 0 THEN 'full' ELSE 'available' END AS label FROM docs WHERE sid = 7""",
    "unpivot_series": W(V.SNAP) + " SELECT d, series, CAST(total AS BIGINT) AS total FROM (UNPIVOT (SELECT d, sum(docks) AS docks, sum(bikes) AS bikes, sum(docks_disabled) AS docks_disabled FROM snap GROUP BY d) ON docks, bikes, docks_disabled INTO NAME series VALUE total)",
    "daily_snapshot_dedup": W(V.SNAP, V.GRID) + " SELECT sid, g, docks, bikes, ok FROM snap_grid WHERE age_s <= 10800",
    "source_priority_dedup": W(V.SNAP) + """, u AS (SELECT sid, date_trunc('hour', t) AS hour, docks, t, 0 AS source FROM snap WHERE docks % 2 = 0 UNION ALL SELECT sid, date_trunc('hour', t), docks, t, 1 FROM snap)
        SELECT sid, hour, docks, CAST(source AS BIGINT) AS source FROM (SELECT *, row_number() OVER (PARTITION BY sid, hour ORDER BY source, t) AS n FROM u) WHERE n = 1""",
    "unseen_stations": W(V.SNAP) + " SELECT DISTINCT sid FROM snap WHERE d > 2 AND sid NOT IN (SELECT sid FROM snap WHERE d <= 2)",
    "center_periphery": W(V.SNAP, V.STATIONS) + """, far AS (SELECT sid, round(pow(lat - (SELECT avg(lat) FROM stations), 2) + pow((lon - (SELECT avg(lon) FROM stations)) * 0.94::DOUBLE, 2), 12) AS d2 FROM stations)
        SELECT sid, d2 <= (SELECT median(d2) FROM far) AS center FROM far""",
    "saturated_station_share": W(V.SNAP) + " SELECT sid, round(avg(CAST(is_full AS INT)), 6) AS rate, count(*) AS n FROM snap WHERE ok AND d <= 18 GROUP BY sid HAVING avg(CAST(is_full AS INT)) >= 0.1",
}
