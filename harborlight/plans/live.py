"""Live scoring, daily partitions, file scans and the small projections around them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlight.config import HORIZONS, LOOKBACK_MIN
from harborlight.functions.timeparts import plus_minutes
from harborlight.plans import views_sql as V
from harborlight.sources import tables as T
from harborlight.sources.shared import shared_folder

R6 = lambda c: F.round(c, 6)
ZONE = "America/Mexico_City"


# files


def write_months(rows: DataFrame, when: str, folder: str) -> None:
    """A Parquet folder a month, named like 2024-03.parquet, so that readers can choose months by name."""
    named = rows.withColumn("_file", F.date_format(when, "yyyy-MM"))
    named.repartition("_file").write.partitionBy("_file").mode("overwrite").parquet(folder)


def read_months(spark: SparkSession, folder: str) -> DataFrame:
    """All files below the folder, with the month that their path names ('' if it names none)."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    return rows.withColumn("month", F.regexp_extract("_metadata.file_path", r"_file=(\d{4}-\d{2})/", 1))


def captured_at(name: Column) -> Column:
    """The time that a capture's file name tells, as in status_20240307T101500Z.json.gz; null without one."""
    return F.try_to_timestamp(F.regexp_extract(name, r"_(\d{8}T\d{6})Z", 1), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")


def recent(rows: DataFrame, when: str, at: Column, minutes: float = LOOKBACK_MIN) -> DataFrame:
    """Rows of the minutes up to and with a time, without the time so long before."""
    return rows.where((F.col(when) > at - F.make_dt_interval(secs=F.lit(minutes * 60))) & (F.col(when) <= at))


MANIFEST = "day date, n long, digest string"


def update_days(rows: DataFrame, day: str, folder: str) -> list[str]:
    """Rewrites the day partitions whose number or sum of digests of rows isn't that of the manifest, and then the manifest; returns those days.

    Only changed days are written (dynamic overwrite), so a run that dies in between is repeated by the next one.
    """
    spark = rows.sparkSession
    digest = F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).cast("string")
    counts = rows.groupBy(F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("n"), digest.alias("digest"))
    try:
        held = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except Exception as e:  # the first run has none
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = spark.createDataFrame([], MANIFEST)
    changed = sorted(r.day for r in counts.join(held, ["day", "n", "digest"], "left_anti").select("day").collect())  # a row a day
    if changed:
        fresh = rows.where(F.col(day).isin(changed)).repartition(day)
        fresh.write.partitionBy(day).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/days")
        kept = held.where(~F.col("day").isin(changed)).unionByName(counts.where(F.col("day").isin(changed)))
        spark.createDataFrame(kept.collect(), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return [str(d) for d in changed]


def put_blobs(rows: DataFrame, folder: str) -> None:
    """Stores the body of each key, text of any lines, where the folder lies in any file system that Spark can name; a key put again is replaced.

    rows: key, body, one row a key. Keys may hold slashes; a key that isn't put stays as it was.
    """
    held = rows.select("key", "body").repartition("key")
    held.write.partitionBy("key").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def get_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """(key, body) of all that is stored; a filter on the key reads that key's folder only."""
    return spark.read.schema("body string, key string").parquet(folder).select("key", "body")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def monthly_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips written a file a month and read back with the month of the path."""
    folder = fresh_folder(spark, "months")
    write_months(T.trips(spark, sf_dir), "departed_at", folder)
    return read_months(spark, folder).groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_min").alias("minutes"))


def daily_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by day: first without a part of two days, then all; only those two days are written again."""
    rows = T.readings(spark, sf_dir).select("sid", "t", "docks", F.to_date("t").alias("day"))
    folder = fresh_folder(spark, "daily")
    update_days(rows.where("day(t) not in (5, 9) or sid % 3 > 0"), "day", folder)
    again = update_days(rows, "day", folder)
    held = spark.read.parquet(f"{folder}/days").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("docks").alias("docks"))
    return held.withColumn("rebuilt", F.col("day").cast("string").isin(again))


def blob_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of each day under a key; two days are put again with another body."""
    rows = T.table(spark, sf_dir, "events").withColumn("key", F.date_format("ts", "'status/'yyyy/MM/dd'.json'"))
    body = F.concat(F.lit('{"n":'), F.count(F.lit(1)), F.lit(',\n"last":'), F.max("event_id"), F.lit("}"))
    folder = fresh_folder(spark, "blobs")
    put_blobs(rows.groupBy("key").agg(body.alias("body")), folder)
    put_blobs(rows.where("day(ts) in (5, 9) and event_type = 'click'").groupBy("key").agg(body.alias("body")), folder)
    return get_blobs(spark, folder)


def capture_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture files of the lookback before each station's last one, by the time in their names."""
    name = F.concat(F.lit("status_"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("Z.json.gz"))
    files = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), name.alias("name")).withColumn("at", captured_at(F.col("name")))
    last = files.groupBy("sid").agg(F.max_by("name", F.struct("at", "name")).alias("last"), F.max("at").alias("until"))
    rows = recent(files.join(last, "sid"), "at", F.col("until"), 2_880)
    return rows.groupBy("sid", "last").agg(F.count(F.lit(1)).alias("n"))


# live scoring


def horizon_predictions(readings: DataFrame, horizon: int) -> DataFrame:
    """(sid, t, p_full_h) of the stations in service that have a forecast for the horizon, at their last time."""
    last = readings.groupBy("sid").agg(F.max_by(F.struct("t", "ok", "k"), "t").alias("r")).select("sid", "r.*")
    scored = last.where("ok").where((F.col("k") + horizon) % 7 != 0)
    return scored.select("sid", "t", (((F.col("k") + horizon) % 100 + 0.5) / 100).cast("double").alias(f"p_full_{horizon}"))


def all_horizons(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row a key that any of the frames has."""
    out, *rest = frames
    for frame in rest:
        out = out.join(frame, keys, "full")
    return out


def full_outer_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.readings(spark, sf_dir)
    return all_horizons([horizon_predictions(r, h) for h in HORIZONS], ["sid", "t"])


def live_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest snapshot with its predictions, those that exist as a map of horizons, and when one would arrive."""
    r = T.readings(spark, sf_dir)
    latest = r.groupBy("sid").agg(F.max_by(F.struct("t", "docks", "bikes"), "t").alias("r")).select("sid", "r.*")
    known = latest.join(full_outer_horizons(spark, sf_dir), ["sid", "t"], "left")
    by_horizon = F.map_from_arrays(F.array(*map(F.lit, HORIZONS)), F.array(*(R6(F.col(f"p_full_{h}")) for h in HORIZONS)))
    there = F.map_filter(by_horizon, lambda h, p: p.isNotNull())
    arrive = plus_minutes(F.col("t"), (F.col("sid") % 20 + 5).cast("int"))
    return known.select("sid", "t", "docks", "bikes", F.to_json(there).alias("p_full"), F.size(there).cast("long").alias("horizons"), arrive.alias("arrive_at"))


def info_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations' fixed facts with their state at the last capture, for those that have both."""
    info = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid"), F.col("s_name").alias("name"), F.round("s_acctbal", 5).alias("balance"))
    state = T.readings(spark, sf_dir).groupBy("sid").agg(F.max_by("docks", "t").cast("long").alias("docks"), F.max("t").alias("t"))
    return info.join(state, "sid").select("sid", "name", "balance", "docks", "t")


def fallback_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two forecasts are one value, of the rows where the second exists."""
    k = F.col("k")
    rows = T.readings(spark, sf_dir).select("d", (k % 10).alias("a"), F.when(k % 4 > 0, F.when(k < 50, k % 10).otherwise(3)).alias("b"))
    return rows.where("b is not null").groupBy("d").agg(F.count(F.lit(1)).alias("n"), R6(F.avg((F.col("a") == F.col("b")).cast("int"))).alias("share"))


def empty_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of full and of empty stations by hour; a station without docks is full if in service, without bikes empty."""
    r = T.readings(spark, sf_dir).where("ok")
    share = lambda c: R6(F.avg((F.col(c) == 0).cast("int")))
    return r.groupBy(F.hour("t").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"), share("docks").alias("full"), share("bikes").alias("empty"))


# dates


def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by the day of the local zone."""
    local = F.from_utc_timestamp(F.col("t").cast("timestamp"), ZONE)
    return T.readings(spark, sf_dir).groupBy(F.to_date(local).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sid").alias("stations"))


def block_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number for each station and day, from 0 in their order: counts of days before a station, and a rank in it."""
    keys = T.readings(spark, sf_dir).select("sid", "d").distinct()
    sizes = keys.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a station
    starts = sizes.select("sid", before.alias("start"))
    rank = F.row_number().over(Window.partitionBy("sid").orderBy("d"))
    return keys.withColumn("rank", rank).join(starts, "sid").select("sid", "d", (F.col("start") + F.col("rank") - 1).cast("long").alias("block"))


def months_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by each month that the 40 days from them touch."""
    begin = F.to_date("o_orderdate")
    months = F.sequence(F.trunc(begin, "month"), F.date_add(begin, 40), F.expr("interval 1 month"))
    return T.table(spark, sf_dir, "orders").select(F.explode(months).alias("month")).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


# records


def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which a second answer of a kind replaces the first."""
    log = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("plan_id"), F.col("event_type").alias("kind"), "event_id", "ts")
    return log.groupBy("plan_id", "kind").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("answers"))


def private_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without name and balance where their segment is private."""
    open_ = ~F.col("c_mktsegment").isin("HOUSEHOLD", "BUILDING")
    return T.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("kind"), F.when(open_, F.col("c_name")).alias("name"), F.when(open_, F.round("c_acctbal", 1)).alias("balance"))


def mapped_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by a dictionary, others as 'other'."""
    words = F.create_map(*map(F.lit, ("view", "seen", "click", "chosen", "purchase", "bought")))
    named = F.coalesce(F.try_element_at(words, F.col("event_type")), F.lit("other"))
    return T.table(spark, sf_dir, "events").groupBy(named.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios whose NaN and infinities are null, with rows without a user left out."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    safe = F.when(F.col("k") % 9 == 0, F.lit(float("nan"))).when(F.col("k") % 11 == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("docks").cast("double"), F.col("bikes").cast("double")))
    rows = T.readings(spark, sf_dir).dropna(subset=["sid"]).select("sid", finite(safe).alias("ratio"))
    return rows.groupBy("sid").agg(F.count("ratio").alias("n"), R6(F.sum("ratio")).alias("total"))


def contains_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand whose name or type has a literal part in any case."""
    part = T.table(spark, sf_dir, "part")
    has = F.contains(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lower(F.lit("AR")))
    return part.where(has).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred pairs, the same ones each time: those with the least digests of key and seed."""
    pairs = T.trips(spark, sf_dir).where("origin_code <> destination_code").select("origin_code", "destination_code").distinct()
    digest = F.md5(F.concat_ws("|", "origin_code", "destination_code", F.lit("7")))
    return pairs.orderBy(digest).limit(100)


def unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order's parts and suppliers the numbers that aren't stations."""
    known = T.readings(spark, sf_dir).select(F.col("sid").alias("id")).distinct()
    asked = T.table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(F.array("l_partkey", "l_suppkey")).alias("id"))
    unknown = asked.join(known, "id", "left_anti").groupBy("l_orderkey").agg(F.collect_set("id").alias("ids"))  # the lines of one order
    return unknown.select("l_orderkey", F.size("ids").cast("long").alias("n"), F.array_min("ids").alias("least"))


def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each line in its order by quantity."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_quantity", "l_linenumber")).cast("long")
    return T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", place.alias("place"))


def nested_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of maps of lists as JSON text and back, keys as numbers again."""
    held = F.create_map(F.col("event_type"), F.create_map((F.col("user_id") % 5).cast("string"), F.array(F.col("event_id"), F.col("user_id"))))
    text = T.table(spark, sf_dir, "events").select("event_id", F.to_json(held).alias("text"))
    back = F.from_json("text", "map<string, map<string, array<bigint>>>")
    inner = F.transform_keys(F.element_at(F.map_values(back), 1), lambda k, _: k.cast("long"))
    return text.select("event_id", F.element_at(F.map_keys(back), 1).alias("kind"), F.element_at(F.map_keys(inner), 1).alias("slot"), F.element_at(F.element_at(F.map_values(inner), 1), 2).alias("last"))


QUERIES = [
    monthly_scan, daily_partitions, blob_sink, capture_window, full_outer_horizons, live_predictions, info_status, fallback_share, empty_target, local_days, block_ids, months_touched,
    latest_records, private_ends, mapped_kinds, finite_values, contains_text, seeded_sample, unknown_ids, walk_order, nested_maps,
]
W = V.with_views
LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY t DESC) AS n FROM snap) WHERE n = 1)"


def _p(h: int) -> str:
    return f"CASE WHEN ok AND (k + {h}) % 7 <> 0 THEN CAST(((k + {h}) % 100 + 0.5) / 100 AS DOUBLE) END"


PARTS = ", ".join(f"""CASE WHEN {_p(h)} IS NOT NULL THEN '"{h}":' || CAST(round({_p(h)}, 6) AS VARCHAR) END""" for h in HORIZONS)
SQL = {
    "monthly_scan": W(V.TRIPS) + " SELECT strftime(departed_at, '%Y-%m') AS month, count(*) AS n, sum(duration_min) AS minutes FROM trips GROUP BY 1",
    "daily_partitions": W(V.SNAP) + " SELECT CAST(t AS DATE) AS day, count(*) AS n, CAST(sum(docks) AS BIGINT) AS docks, bool_or(day(t) IN (5, 9) AND sid % 3 = 0) AS rebuilt FROM snap GROUP BY 1",
    "blob_sink": """WITH e AS (SELECT strftime(ts, 'status/%Y/%m/%d.json') AS key, day(ts) IN (5, 9) AS again, event_type = 'click' AS click, event_id FROM events)
        SELECT key, '{"n":' || count(*) || ',' || chr(10) || '"last":' || max(event_id) || '}' AS body FROM e WHERE click OR NOT again GROUP BY 1""",
    "capture_window": """WITH f AS (SELECT user_id AS sid, date_trunc('second', ts) AS w FROM events), l AS (SELECT sid, max(w) AS until FROM f GROUP BY 1)
        SELECT sid, 'status_' || strftime(until, '%Y%m%dT%H%M%S') || 'Z.json.gz' AS last, count(*) AS n FROM f JOIN l USING (sid) WHERE w > until - INTERVAL 2880 MINUTE AND w <= until GROUP BY 1, 2""",
    "full_outer_horizons": W(V.SNAP, LAST) + f" SELECT sid, t, {', '.join(f'{_p(h)} AS p_full_{h}' for h in HORIZONS)} FROM last WHERE {' OR '.join(f'{_p(h)} IS NOT NULL' for h in HORIZONS)}",
    "live_predictions": W(V.SNAP, LAST) + f""" SELECT sid, t, docks, bikes, '{{' || concat_ws(',', {PARTS}) || '}}' AS p_full,
        CAST({' + '.join(f'CAST({_p(h)} IS NOT NULL AS INT)' for h in HORIZONS)} AS BIGINT) AS horizons, t + to_minutes(CAST(sid % 20 + 5 AS BIGINT)) AS arrive_at FROM last""",
    "info_status": W(V.SNAP, LAST) + " SELECT sid, s_name AS name, round(s_acctbal, 5) AS balance, CAST(docks AS BIGINT) AS docks, t FROM supplier JOIN last ON sid = s_suppkey",
    "fallback_share": W(V.SNAP) + " SELECT d, count(*) AS n, round(avg(CAST(k % 10 = CASE WHEN k < 50 THEN k % 10 ELSE 3 END AS INT)), 6) AS share FROM snap WHERE k % 4 > 0 GROUP BY 1",
    "empty_target": W(V.SNAP) + " SELECT hour(t) AS hour, count(*) AS n, round(avg(CAST(docks = 0 AS INT)), 6) AS \"full\", round(avg(CAST(bikes = 0 AS INT)), 6) AS empty FROM snap WHERE ok GROUP BY 1",
    "local_days": "SELECT CAST(ts - INTERVAL 6 HOUR AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS stations FROM events GROUP BY 1",
    "block_ids": W(V.SNAP) + " SELECT DISTINCT sid, d, dense_rank() OVER (ORDER BY sid, d) - 1 AS block FROM snap",
    "months_touched": """SELECT CAST(month AS DATE) AS month, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('month', o_orderdate), CAST(o_orderdate AS DATE) + INTERVAL 40 DAY, INTERVAL 1 MONTH)) AS month FROM orders) GROUP BY 1""",
    "latest_records": "SELECT user_id AS plan_id, event_type AS kind, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS answers FROM events GROUP BY 1, 2",
    "private_ends": "SELECT c_custkey, c_mktsegment AS kind, CASE WHEN c_mktsegment NOT IN ('HOUSEHOLD', 'BUILDING') THEN c_name END AS name, CASE WHEN c_mktsegment NOT IN ('HOUSEHOLD', 'BUILDING') THEN round(c_acctbal, 1) END AS balance FROM customer",
    "mapped_kinds": "SELECT CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'chosen' WHEN 'purchase' THEN 'bought' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "finite_values": W(V.SNAP) + " SELECT sid, count(r) AS n, round(sum(r), 6) AS total FROM (SELECT sid, CASE WHEN k % 9 <> 0 AND k % 11 <> 0 AND bikes <> 0 THEN docks / CAST(bikes AS DOUBLE) END AS r FROM snap) GROUP BY 1",
    "contains_text": "SELECT p_brand, count(*) AS n, min(p_partkey) AS first FROM part WHERE contains(lower(p_name || ' ' || p_type), 'ar') GROUP BY 1",
    "seeded_sample": W(V.TRIPS) + " SELECT origin_code, destination_code FROM (SELECT DISTINCT origin_code, destination_code FROM trips WHERE origin_code <> destination_code) ORDER BY md5(origin_code || '|' || destination_code || '|7') LIMIT 100",
    "unknown_ids": """SELECT l_orderkey, count(DISTINCT id) AS n, min(id) AS least FROM (SELECT l_orderkey, unnest([l_partkey, l_suppkey]) AS id FROM lineitem) WHERE id NOT IN (SELECT user_id FROM events) GROUP BY 1""",
    "walk_order": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS place FROM lineitem",
    "nested_maps": "SELECT event_id, event_type AS kind, user_id % 5 AS slot, user_id AS last FROM events",
}
