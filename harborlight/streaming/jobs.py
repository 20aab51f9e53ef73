"""The same logic on streams: captures as they come, de-duplicated, counted by slot and joined with their labels."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlight.config import STALE_AFTER_S
from harborlight.plans import learning as L
from harborlight.plans import views_sql as V
from harborlight.sources import tables as T
from harborlight.sources.shared import saved, shared_folder

LATE = "3 hours"
#: Rows a file of a feed, about; a batch has as many files as its rows need.
FILE_ROWS = 250_000


def deduplicated(stream: DataFrame) -> DataFrame:
    return stream.withWatermark("t", LATE).dropDuplicatesWithinWatermark(["sid", "t"])


def slot_counts(stream: DataFrame) -> DataFrame:
    """Readings and full ones by 15-minute slot."""
    at = F.window("t", "15 minutes")
    return stream.withWatermark("t", LATE).groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_full").alias("n_full")).select(F.col("window.start").alias("slot_start"), "n", "n_full")


def with_labels(stream: DataFrame, horizon: int, tolerance: int) -> DataFrame:
    """All later readings in the window of each reading; the first one of them is taken by first_labels."""
    now = stream.where("ok").select(F.col("sid").alias("sid_now"), F.col("t").alias("t_now")).withWatermark("t_now", LATE)
    then = stream.select("sid", "t", "ok", "is_full").withWatermark("t", LATE)
    low, high = (F.expr(f"interval {horizon - tolerance} minutes"), F.expr(f"interval {horizon + tolerance} minutes"))
    inside = (F.col("sid_now") == F.col("sid")) & (F.col("t") >= F.col("t_now") + low) & (F.col("t") <= F.col("t_now") + high)
    return now.join(then, inside)


def first_labels(met: DataFrame) -> DataFrame:
    """Of the readings met by one the first; a bad one drops it."""
    first = met.groupBy("sid_now", "t_now").agg(F.min_by(F.struct("ok", "is_full"), "t").alias("m"))
    return first.where("m.ok").select(F.col("sid_now").alias("sid"), F.col("t_now").alias("t"), F.col("m.is_full").alias("y"))


def latest_lag(previous: DataFrame, batch: DataFrame, minutes: int) -> DataFrame:
    """A micro-batch with the last state before it that is recent enough: batch and lookback rows in one window."""
    both = previous.withColumn("new", F.lit(False)).unionByName(batch.withColumn("new", F.lit(True)))
    order = Window.partitionBy("sid").orderBy("t", "event_id")
    before = F.lag(F.struct("t", "is_full")).over(order)
    rows = both.withColumn("b", before).where("new")
    recent = F.unix_micros("t") - F.unix_micros("b.t") <= minutes * 60_000_000
    return rows.select("event_id", "sid", "t", "is_full", F.when(recent, F.col("b.is_full")).alias("was_full"))


def in_turn(spark: SparkSession, parts: Iterable[DataFrame], files: int) -> str:
    """A folder to which the parts were added one after the other, each as so many files, so that many tasks write and read a part.

    Tasks without rows write no file; empty ones make up for them, as a batch takes the same number of files each time.
    """
    folder = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}-by-{files}"
    for n, part in enumerate(parts, 1):  # in their order, so that files are found in that order
        part.coalesce(files).write.mode("append").parquet(folder)
        for _ in range(n * files - len(spark.read.schema(part.schema).parquet(folder).inputFiles())):
            part.limit(0).write.mode("append").parquet(folder)
    return folder


def files_for(rows: DataFrame, parts: int) -> int:
    return max(1, -(-rows.count() // (parts * FILE_ROWS)))


def files_a_batch(folder: str) -> int:
    """Files of a part in a folder of in_turn; in other folders each file is a part."""
    named = re.search(r"-by-(\d+)$", folder)
    return int(named[1]) if named else 1


def in_parts(spark: SparkSession, sf_dir: str, days: int = 8) -> str:
    """A folder to which the events of so many days at a time were added, as a feed would add them."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    part, count = F.floor((F.day("ts") - 1) / days), -(-31 // days)
    return in_turn(spark, (rows.where(part == n) for n in range(count)), files_for(rows, count))


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of the folder, a part a micro-batch."""
    schema = spark.read.parquet(folder).schema
    k = F.get_json_object("props", "$.k").cast("int")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch(folder)).parquet(folder)
    return stream.select("event_id", F.col("user_id").alias("sid"), F.col("ts").cast("timestamp").alias("t"), (F.col("event_type") != "error").alias("ok"), (k % 10 == 0).alias("is_full"), (k * 200).alias("age_s"))


def with_lookback(stream: DataFrame, minutes: int) -> DataFrame:
    """Every reading with the state before it: a micro-batch meets the rows written earlier that are recent enough, whatever batch they came in.

    A batch writes to a partition of its own number and reads only those before it, so a batch that is run again after a failure
    gives the same rows. Rows that come later than rows after them don't change what those have been given.
    """
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/lookback-{uuid.uuid4().hex}"
    kind = "event_id long, sid long, t timestamp, is_full boolean, was_full boolean"

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.select("event_id", "sid", "t", "is_full")
        least = batch.agg(F.min("t")).first()[0]
        if least is None:
            return
        if n:  # partitions before this one
            old = batch.sparkSession.read.schema(f"{kind}, batch long").parquet(f"{out}/rows").where(F.col("batch") < n)
            old = old.where(F.col("t") >= F.lit(least) - F.make_dt_interval(mins=F.lit(minutes))).select("event_id", "sid", "t", "is_full")
        else:
            old = batch.limit(0)
        latest_lag(old, batch, minutes).write.mode("overwrite").parquet(f"{out}/rows/batch={n}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{kind}, batch long").parquet(f"{out}/rows")


def score_counts(stream: DataFrame, length: str = "28 days", step: str = "7 days") -> DataFrame:
    """Readings and full ones by trailing window, stepped by the week: what a weekly recalibration is fitted on."""
    at = F.window("t", length, step)
    counted = stream.withWatermark("t", LATE).groupBy(at, "age_s").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_full").alias("hits"))
    return counted.select(F.col("window.end").alias("until"), "age_s", "n", "hits")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote; the sink and its state lie in the shared folder."""
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")).start()  # a repeated batch replaces itself
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows").select(*stream.columns)


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drained(deduplicated(feed(spark, in_parts(spark, sf_dir))))
    return rows.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))


def stream_slot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drained(slot_counts(feed(spark, in_parts(spark, sf_dir))), "update").groupBy("slot_start").agg(F.max("n").alias("n"), F.max("n_full").alias("n_full"))
    return rows.select(F.col("slot_start").cast("timestamp_ntz").alias("slot_start"), "n", "n_full")


def stream_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = first_labels(drained(with_labels(feed(spark, in_parts(spark, sf_dir)), 720, 360)))
    return rows.select("sid", F.col("t").cast("timestamp_ntz").alias("t"), "y")


def stream_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_lookback(feed(spark, in_parts(spark, sf_dir)), 1_440)
    return rows.select("event_id", "sid", "is_full", "was_full")


def stream_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that aren't stale, over several micro-batches."""
    rows = drained(feed(spark, in_parts(spark, sf_dir)).where(F.col("age_s") <= STALE_AFTER_S))
    return rows.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_full").alias("n_full"))


def stream_trailing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drained(score_counts(feed(spark, in_parts(spark, sf_dir))), "update").groupBy("until", "age_s").agg(F.max("n").alias("n"), F.max("hits").alias("hits"))
    return rows.select(F.col("until").cast("timestamp_ntz").alias("until"), "age_s", "n", "hits")


def scored(stream: DataFrame, rates: DataFrame, usual: float) -> DataFrame:
    """Each reading in service once, with its station's rate, or the usual one where the station has none: a stream joined with a stored table."""
    rows = deduplicated(stream.where("ok").select("sid", "t"))
    return rows.join(rates.select("sid", "p"), "sid", "left").select("sid", "t", F.coalesce("p", F.lit(usual)).alias("p"))


def stream_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction a capture file; a batch that is run again replaces what it wrote, so no capture is scored twice."""
    ex = saved(L.examples(T.readings(spark, sf_dir)).where(F.col("d").between(*L.TRAIN)).select("sid", F.col("y").cast("int").alias("y")))
    rates = saved(ex.groupBy("sid").agg(F.avg("y").alias("p"), F.count(F.lit(1)).alias("n")).where("n >= 10"))
    usual = ex.agg(F.avg("y")).first()[0] or 0.0
    rows = drained(scored(feed(spark, in_parts(spark, sf_dir)), rates, usual))
    return rows.select("sid", F.col("t").cast("timestamp_ntz").alias("t"), F.round("p", 6).alias("p"))


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [stream_dedup, stream_slot_counts, stream_label_join, stream_lookback, stream_fresh, stream_trailing_counts, stream_predictions]
SQL = {
    "stream_dedup": "SELECT user_id AS sid, count(DISTINCT ts) AS n FROM events GROUP BY 1",
    "stream_slot_counts": V.with_views(V.SNAP) + " SELECT time_bucket(INTERVAL 15 MINUTE, t) AS slot_start, count(*) AS n, count(*) FILTER (is_full) AS n_full FROM snap GROUP BY 1",
    "stream_label_join": V.with_views(V.SNAP, V.examples()) + " SELECT sid, t, y FROM ex",
    "stream_lookback": V.with_views(V.SNAP) + """, e AS (SELECT event_id, user_id AS sid, ts, CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 AS is_full FROM events),
        b AS (SELECT *, lag(ts) OVER w AS b_ts, lag(is_full) OVER w AS b_full FROM e WINDOW w AS (PARTITION BY sid ORDER BY ts, event_id))
        SELECT event_id, sid, is_full, CASE WHEN ts - b_ts <= INTERVAL 1440 MINUTE THEN b_full END AS was_full FROM b""",
    "stream_fresh": V.with_views(V.SNAP) + f" SELECT sid, count(*) AS n, count(*) FILTER (is_full) AS n_full FROM snap WHERE age_s <= {STALE_AFTER_S} GROUP BY 1",
    "stream_trailing_counts": V.with_views(V.SNAP) + """, w AS (SELECT time_bucket(INTERVAL 7 DAY, t, TIMESTAMP '1970-01-01') + INTERVAL 7 DAY + unnest([0, 7, 14, 21]) * INTERVAL 1 DAY AS until, age_s, is_full FROM snap)
        SELECT until, age_s, count(*) AS n, count(*) FILTER (is_full) AS hits FROM w GROUP BY 1, 2""",
    "stream_predictions": V.with_views(V.SNAP, V.examples()) + f""", tr AS (SELECT sid, CAST(y AS INT) AS y FROM ex WHERE d BETWEEN {L.TRAIN[0]} AND {L.TRAIN[1]}), r AS (SELECT sid, avg(y) AS p FROM tr GROUP BY 1 HAVING count(*) >= 10)
        SELECT s.sid, s.t, round(coalesce(r.p, (SELECT avg(y) FROM tr), 0), 6) AS p FROM (SELECT DISTINCT sid, t FROM snap WHERE ok) s LEFT JOIN r ON r.sid = s.sid""",
}
