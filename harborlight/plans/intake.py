"""What comes in: capture files by name and as a source, syncs, published versions, archives, trip files, and mornings seen whole."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlight.operators import stations as S
from harborlight.plans import views_sql as V
from harborlight.plans.live import fresh_folder
from harborlight.plans.stations import LABEL
from harborlight.sources import captures, files, trip_files
from harborlight.sources import tables as T
from harborlight.sources.shared import saved

FEED = "station_status"
ZONE_HOURS = 6
#: Characters of windows-1252 beyond iso-8859-1.
ODD = "€–“x”™Š"
#: Minutes that a capture covers.
EVERY = 15
#: Upper bounds in minutes of a station's silence.
SILENCE = ((30, "< 30 min"), (60, "30-60 min"), (180, "1-3 h"), (1_440, "3-24 h"))


def capture_tree(spark: SparkSession, sf_dir: str, root: str, days: str = "true") -> str:
    """The feed's captures (of the days of a condition on g) as files: <feed>/YYYY/MM/DD/<feed>_<time>Z.json.gz."""
    rows = T.captures(spark, sf_dir).where(days)
    key = F.concat(F.lit(f"{FEED}/"), F.date_format("g", "yyyy/MM/dd"), F.lit(f"/{FEED}_"), F.date_format("g", "yyyyMMdd'T'HHmmss"), F.lit("Z.json.gz"))
    files.write_files(rows.select(key.alias("key"), F.col("document").alias("body")), root, compress=True)
    return root


def capture_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations of the captures of the days before the 20th, by a window that chooses files."""
    root = capture_tree(spark, sf_dir, fresh_folder(spark, "tree"))
    rows = captures.read(spark, f"{root}/{FEED}", dt.datetime(2024, 1, 16, 12), dt.datetime(2024, 1, 20))
    return rows.select("file", F.col("station_id").cast("long").alias("sid"), F.col("num_docks_available").alias("docks"))


def capture_shots(spark: SparkSession, folder: str, out: str) -> None:
    """One run over the captures that are new since the run before, as a timer starts it; a batch that is run again replaces itself."""
    stream = captures.registered(spark).readStream.format("captures").load(folder)
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def capture_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures through the stream source in two runs, the second one after more files came, counted by file and run."""
    root, out = fresh_folder(spark, "tree"), fresh_folder(spark, "shots")
    for days in ("day(g) <= 12", "day(g) > 12"):
        capture_tree(spark, sf_dir, root, days)
        capture_shots(spark, f"{root}/{FEED}", out)
    rows = spark.read.schema(f"{captures.SCHEMA}, batch long").parquet(f"{out}/rows")
    return rows.groupBy("file", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("num_docks_available").alias("docks"))


def sync_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two syncs of a window of days: the second one copies only what has another size since, and what is new in the window."""
    source, target = capture_tree(spark, sf_dir, fresh_folder(spark, "remote")), fresh_folder(spark, "local")
    days = dt.date(2024, 1, 3), dt.date(2024, 1, 12)
    first = files.synced(spark, source, target, FEED, days)
    more = spark.createDataFrame([(f"{FEED}/2024/01/{d:02}/{FEED}_202401{d:02}T{h:02}0000Z.json.gz", bytearray(b"x" * 7)) for d, h in ((5, 0), (9, 0), (11, 12), (20, 0))], "key string, body binary")
    files.write_files(more, source)
    second = files.synced(spark, source, target, FEED, days)
    held = files.listed(spark, target)
    return held.select("key", F.col("key").isin(first).alias("first"), F.col("key").isin(second).alias("second"))


def atomic_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published counts by day after a run that died between its data and the pointer, and the clean-up behind it."""
    folder = fresh_folder(spark, "published")
    counts = T.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    files.publish(counts, folder)
    try:
        files.publish(counts.withColumn("n", F.lit(0).cast("long")), folder, stop_before_pointer=True)
    except RuntimeError:
        pass
    left = len(files.recovered(folder))
    return files.current(spark, folder).withColumn("left_over", F.lit(left).cast("long"))


def zipped_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts through zip archives of windows-1252 CSV files, a thousand parts an archive, two files in each."""
    folder = fresh_folder(spark, "zips")
    rows = T.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(f' "{ODD}"')).alias("name"), F.floor(F.col("p_partkey") / 1_000).alias("archive"))

    def archived(part: pd.DataFrame) -> pd.DataFrame:
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as archive:
            for k in range(2):
                mine = part[part.p_partkey % 2 == k][["name", "p_partkey"][:: 1 - 2 * k]]  # the columns' order differs
                archive.writestr(f"conjunto/denue_{k}.csv", mine.to_csv(index=False).encode("cp1252"))
            archive.writestr("leer.txt", b"x")
        return pd.DataFrame({"key": [f"parts_{part.archive.iloc[0]}.zip"], "body": [body.getvalue()]})

    files.write_files(rows.groupBy("archive").applyInPandas(archived, "key string, body binary"), folder)
    paths = files.listed(spark, folder).select(F.concat(F.lit(f"{folder}/"), "key").alias("path"))
    found = files.unzipped(files.members(paths), ["p_partkey", "name"])
    return found.select(F.col("p_partkey").cast("long").alias("p_partkey"), "name", F.regexp_extract("member", "([^/]+)$", 1).alias("member"))


def whole_mornings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each local working-day morning (07:00 to 11:00) that lies between the first and the last capture: captures in it, minutes
    that captures cover (EVERY each, overlaps once), and the longest stretch without.
    """
    local = F.col("t") - F.make_dt_interval(hours=F.lit(ZONE_HOURS))
    times = T.readings(spark, sf_dir).select(local.alias("t")).distinct().withColumn("day", F.to_date("t"))
    span = times.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    clock = lambda h: (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(h))).alias
    days = span.select("a", "b", F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("day")).where(F.weekday("day") < 5)
    days = days.select("a", "b", "day", clock(7)("start"), clock(11)("end")).where("a <= start and end <= b").drop("a", "b")
    minutes = lambda x, y: F.timestamp_diff("MICROSECOND", x, y) / 60e6
    seen = times.join(F.broadcast(days), "day").where((F.col("t") > F.col("start") - F.make_dt_interval(mins=F.lit(EVERY))) & (F.col("t") < F.col("end")))  # a row a day
    order = Window.partitionBy("day").orderBy("t")
    until, after = F.col("t") + F.make_dt_interval(mins=F.lit(EVERY)), F.coalesce(F.lead("t").over(order), F.col("end"))
    seen = seen.withColumns({"after": after, "lead_gap": F.when(F.row_number().over(order) == 1, F.greatest(F.lit(0.0), minutes(F.col("start"), F.col("t"))))})
    got = seen.groupBy("day").agg(
        F.count_if(F.col("t") >= F.col("start")).alias("n"), F.sum(minutes(F.greatest("t", "start"), F.least(until, F.col("after"), F.col("end")))).alias("covered"),
        F.max(F.greatest(F.coalesce("lead_gap", F.lit(0.0)), minutes(until, F.col("after")))).alias("longest"),
    )
    return days.join(got, "day", "left").select(
        "day", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("covered", F.lit(0.0)), 3).alias("covered_min"), F.round(F.coalesce("longest", F.lit(240.0)), 3).alias("longest_gap_min")
    )


# The three ways in which headers of trip files have been written.
HEADERS = (
    ("Genero_Usuario", "Edad_Usuario", "Bici", "Ciclo_Estacion_Retiro", "Fecha_Retiro", "Hora_Retiro", "Ciclo_Estacion_Arribo", "Fecha_Arribo", "Hora_Arribo"),
    ("Genero_Usuario", "Edad_Usuario", "Bici", "Ciclo_Estacion_Retiro", "Fecha_Retiro", "Hora_Retiro", "Ciclo_EstacionArribo", "Fecha Arribo", "Hora_Arribo"),
    ("\ufeffbici", "ce_retiro", "fecha_retiro", "hora_retiro", "ce_arribo", "fecha_arribo", "hora_arribo"),
)
YEARS = 32
#: Files of a month at most, so that no task writes a whole one.
MONTH_FILES = 4


def trip_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips written as one CSV folder a month, each with one of the three headers, and read by month; the later upload of a month counts."""
    trips = T.trips(spark, sf_dir)
    moved = {c: F.col(c) + F.make_ym_interval(F.lit(YEARS)) for c in ("departed_at", "arrived_at")}
    rows = trips.withColumns(moved).withColumn("month", F.date_format("departed_at", "yyyy-MM"))
    rows = rows.withColumns({"_style": F.pmod(F.month("departed_at"), F.lit(3)), "_file": F.day("departed_at") % MONTH_FILES})
    folder, tasks = fresh_folder(spark, "trip-files"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = [f"{folder}/style-{r._style}/month={r.month}" for r in rows.select("_style", "month").distinct().collect()]  # a row a month
    for k, header in enumerate(HEADERS):
        day = "d/M/yy" if k == 2 else "dd/MM/yyyy"
        value = {
            "bici": F.lit("7"), "retiro": F.col("origin_code"), "arribo": F.col("destination_code"), "fecha_retiro": F.date_format("departed_at", day), "fecha_arribo": F.date_format("arrived_at", day),
            "hora_retiro": F.date_format("departed_at", "H:mm:ss"), "hora_arribo": F.date_format("arrived_at", "H:mm:ss"),
        }
        name = lambda c: c.strip("\ufeff").lower().replace(" ", "_")
        pick = lambda c: value.get(name(c), value["retiro"] if "retiro" in name(c) else value["arribo"] if "arribo" in name(c) else F.lit("M"))
        mine = rows.where(F.col("_style") == k).select("month", "_file", *(pick(c).alias(c) for c in header)).repartition(tasks, "month", "_file").drop("_file")
        mine.write.partitionBy("month").option("header", True).csv(f"{folder}/style-{k}")
    months = trip_files.read_months(spark, paths)
    return months.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration_min"), 3).alias("minutes"), F.countDistinct("origin_code").alias("origins"))


def record_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers appended to a log of JSON lines by day, in two runs; read back, the last one of a plan and kind counts."""
    folder = fresh_folder(spark, "log")
    rows = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("plan_id"), F.col("event_type").alias("kind"), "event_id", F.col("ts").alias("received_at"), "value")
    for run in ("event_id % 2 = 0", "event_id % 2 = 1"):
        rows.where(run).withColumn("day", F.to_date("received_at")).repartition("day").write.mode("append").partitionBy("day").json(folder)
    log = spark.read.schema("plan_id long, kind string, event_id long, received_at timestamp_ntz, value double").json(folder)
    last = F.max_by(F.struct("event_id", "value"), F.struct("received_at", "event_id"))
    return log.groupBy("plan_id", "kind").agg(last.alias("r"), F.count(F.lit(1)).alias("answers")).select("plan_id", "kind", "r.event_id", F.round("r.value", 6).alias("value"), "answers")


def stations_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, station): the stations that have one; of a code the first."""
    rows = T.table(spark, sf_dir, "supplier").where("s_nationkey % 4 > 0").select(F.lpad((F.col("s_suppkey") % 100).cast("string"), 3, "0").alias("code"), "s_suppkey")
    return rows.groupBy("code").agg(F.min("s_suppkey").alias("station"))


def mapped_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips between stations of the feed, both ends by their code; trips with an end that has no station are left out."""
    codes = stations_by_code(spark, sf_dir)
    of = lambda end: codes.select(F.col("code").alias(f"{end}_code"), F.col("station").alias(f"{end}_id"))
    rows = T.trips(spark, sf_dir).join(of("origin"), "origin_code").join(of("destination"), "destination_code")
    return rows.groupBy("origin_id", "destination_id").agg(F.count(F.lit(1)).alias("n"), F.median("duration_min").alias("minutes"))


def period_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind of event the first and last time, its days as a list, and how many values are null or not positive."""
    rows = T.table(spark, sf_dir, "events").withColumn("v", F.nullif(F.floor(F.abs("value")), F.lit(0)))
    days = F.array_join(F.array_sort(F.collect_set(F.date_format("ts", "MM-dd"))), ",")  # a period's days
    return rows.groupBy("event_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), days.alias("days"), F.count_if(F.col("v").isNull()).alias("null_count"), F.countDistinct("user_id").alias("stations"))


def capture_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures' report as one table (section, item, n): how many there are of those expected, gaps by day, captures that
    repeat the document before (by the minute that it was made), labels, silences and whole mornings.
    """
    r = saved(T.readings(spark, sf_dir))
    times = saved(r.select("t").distinct())
    part = lambda section, item, n: [F.lit(section).alias("section"), item.cast("string").alias("item"), n.cast("long").alias("n")]
    span = F.timestamp_diff("SECOND", F.min("t"), F.max("t"))
    made = F.date_trunc("minute", "t")
    total = times.agg(F.count(F.lit(1)).alias("captures"), (F.floor(span / (EVERY * 60)) + 1).alias("expected"), (F.count(F.lit(1)) - F.countDistinct(made)).alias("repeated"))
    totals = total.unpivot([], ["captures", "expected", "repeated"], "item", "n")
    long_gaps = S.gaps(times).where(F.col("gap_min") > 2 * EVERY).groupBy(F.to_date("t").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    labels = r.groupBy(S.label(F.col("ok"), F.col("age_s"), F.col("is_full")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    minutes = F.col("age_s") / 60
    bucket = F.when(minutes.isNull(), "never")
    for bound, name in SILENCE:
        bucket = bucket.when(minutes < bound, name)
    silence = r.where("ok").groupBy(bucket.otherwise("> 1 day").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    out = totals.select(*part("totals", F.col("item"), F.col("n"))).unionByName(long_gaps.select(*part("gaps", F.col("day"), F.col("n"))))
    out = out.unionByName(labels.select(*part("labels", F.col("label"), F.col("n")))).unionByName(silence.select(*part("silence", F.col("bucket"), F.col("n"))))
    return out.unionByName(whole_mornings(spark, sf_dir).select(*part("mornings", F.col("day"), F.col("n"))))


QUERIES = [capture_source, capture_stream, sync_manifest, atomic_publish, zipped_csv, whole_mornings, trip_months, record_log, mapped_trips, period_facts, capture_report]
_DAILY = V.with_views(V.SNAP) + ", last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, date_trunc('day', t) ORDER BY t DESC) AS rn FROM snap) WHERE rn = 1)"
_NAME = "strftime(date_trunc('day', t), 'station_status_%Y%m%dT%H%M%SZ.json.gz')"
SQL = {
    "capture_source": _DAILY + f" SELECT {_NAME} AS file, sid, docks FROM last WHERE date_trunc('day', t) BETWEEN TIMESTAMP '2024-01-17' AND TIMESTAMP '2024-01-20'",
    "capture_stream": _DAILY + f" SELECT {_NAME} AS file, CAST(day(t) > 12 AS BIGINT) AS batch, count(*) AS n, CAST(sum(docks) AS BIGINT) AS docks FROM last GROUP BY 1, 2",
    "sync_manifest": """WITH d AS (SELECT DISTINCT date_trunc('day', ts) AS d FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-13'),
        f AS (SELECT d AS t, true AS first, day(d) IN (5, 9) AS second FROM d UNION SELECT TIMESTAMP '2024-01-11 12:00:00', false, true)
        SELECT strftime(t, 'station_status/%Y/%m/%d/station_status_%Y%m%dT%H%M%SZ.json.gz') AS key, first, second FROM f""",
    "atomic_publish": "SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(1 AS BIGINT) AS left_over FROM events GROUP BY 1",
    "zipped_csv": f"""SELECT p_partkey, p_name || ' "{ODD}"' AS name, 'denue_' || p_partkey % 2 || '.csv' AS member FROM part""",
    "trip_months": f"""SELECT strftime(l_shipdate + INTERVAL {YEARS} YEAR, '%Y-%m') AS month, count(*) AS n, round(sum(l_quantity), 3) AS minutes, count(DISTINCT l_suppkey % 100) AS origins FROM
        (SELECT *, l_shipdate + (l_orderkey % 96 * 15) * INTERVAL 1 MINUTE AS dep FROM lineitem) GROUP BY 1""",
    "record_log": """SELECT plan_id, kind, event_id, round(value, 6) AS value, answers FROM (SELECT user_id AS plan_id, event_type AS kind, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k,
        count(*) OVER (PARTITION BY user_id, event_type) AS answers FROM events) WHERE k = 1""",
    "mapped_trips": V.with_views(V.TRIPS) + """, c AS (SELECT lpad(CAST(s_suppkey % 100 AS VARCHAR), 3, '0') AS code, min(s_suppkey) AS station FROM supplier WHERE s_nationkey % 4 > 0 GROUP BY 1)
        SELECT a.station AS origin_id, b.station AS destination_id, count(*) AS n, median(duration_min) AS minutes FROM trips JOIN c a ON a.code = origin_code JOIN c b ON b.code = destination_code GROUP BY 1, 2""",
    "period_facts": """SELECT event_type, min(ts) AS first, max(ts) AS last, array_to_string(list_sort(list(DISTINCT strftime(ts, '%m-%d'))), ',') AS days,
        count(*) FILTER (floor(abs(value)) = 0 OR value IS NULL) AS null_count, count(DISTINCT user_id) AS stations FROM events GROUP BY 1""",
    "whole_mornings": f"""WITH c AS (SELECT DISTINCT ts - INTERVAL {ZONE_HOURS} HOUR AS t FROM events),
        d AS (SELECT CAST(x AS DATE) AS day, x + INTERVAL 7 HOUR AS a, x + INTERVAL 11 HOUR AS b FROM (SELECT unnest(generate_series((SELECT date_trunc('day', min(t)) FROM c), (SELECT max(t) FROM c), INTERVAL 1 DAY)) AS x)
          WHERE isodow(x) < 6 AND x + INTERVAL 7 HOUR >= (SELECT min(t) FROM c) AND x + INTERVAL 11 HOUR <= (SELECT max(t) FROM c)),
        s AS (SELECT day, a, b, t, t + INTERVAL {EVERY} MINUTE AS u, coalesce(lead(t) OVER w, b) AS nx, CASE WHEN row_number() OVER w = 1 THEN greatest(0, epoch(t) - epoch(a)) / 60 ELSE 0 END AS g
          FROM d JOIN c ON t > a - INTERVAL {EVERY} MINUTE AND t < b WINDOW w AS (PARTITION BY day ORDER BY t)),
        m AS (SELECT day, count(*) FILTER (t >= a) AS n, sum(epoch(least(u, nx, b)) - epoch(greatest(t, a))) / 60 AS covered, greatest(max(g), max((epoch(nx) - epoch(u)) / 60)) AS longest FROM s GROUP BY 1)
        SELECT day, coalesce(n, 0) AS n, round(coalesce(covered, 0.0), 3)::DOUBLE AS covered_min, round(greatest(0.0, coalesce(longest, 240.0)), 3)::DOUBLE AS longest_gap_min FROM d LEFT JOIN m USING (day)""",
}
_BUCKETS = " ".join(f"WHEN age_s / 60.0 < {bound} THEN '{name}'" for bound, name in SILENCE)
SQL["capture_report"] = V.with_views(V.SNAP) + f""", times AS (SELECT DISTINCT t FROM snap), gap AS (SELECT t, epoch_us(t) - lag(epoch_us(t)) OVER (ORDER BY t) AS g FROM times), mornings AS ({SQL["whole_mornings"]})
        SELECT 'totals' AS section, item, n FROM (SELECT unnest(['captures', 'expected', 'repeated']) AS item, unnest([count(*), CAST(floor(date_sub('second', min(t), max(t)) / {EVERY * 60}) AS BIGINT) + 1, count(*) - count(DISTINCT date_trunc('minute', t))]) AS n FROM times)
        UNION ALL SELECT 'gaps', CAST(CAST(t AS DATE) AS VARCHAR), count(*) FROM gap WHERE g / 60e6 > {2 * EVERY} GROUP BY 2
        UNION ALL SELECT 'labels', {LABEL}, count(*) FROM snap GROUP BY 2
        UNION ALL SELECT 'silence', CASE WHEN age_s IS NULL THEN 'never' {_BUCKETS} ELSE '> 1 day' END, count(*) FROM snap WHERE ok GROUP BY 2
        UNION ALL SELECT 'mornings', CAST(day AS VARCHAR), n FROM mornings"""
