"""Station readings, trips, weather and captures over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlight.functions.timeparts import plus_minutes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station reading per event: sid, t, d (day of the month), ok, is_full, docks, bikes, docks_disabled, capacity, lat, lon."""
    return as_readings(table(spark, sf_dir, "events"))


def as_readings(events: DataFrame) -> DataFrame:
    k, user = F.get_json_object("props", "$.k").cast("int"), F.col("user_id")
    return events.select(
        user.alias("sid"), F.col("ts").alias("t"), F.day("ts").cast("long").alias("d"), (F.col("event_type") != "error").alias("ok"),
        (k % 10 == 0).alias("is_full"), (k % 10).alias("docks"), (19 - k % 20).alias("bikes"), (k % 3).alias("docks_disabled"),
        F.lit(20).alias("capacity"), (F.lit(19.40) + (user % 40) * 0.001).cast("double").alias("lat"),
        (F.lit(-99.17) + F.floor(user / 40) * 0.001).cast("double").alias("lon"), (k * 200).alias("age_s"), k.alias("k"),
    )


def daily_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_of_day(readings(spark, sf_dir))


def last_of_day(rows: DataFrame) -> DataFrame:
    """The last reading of each station and day, at the shared time g."""
    day = F.date_trunc("day", "t").cast("timestamp_ntz")
    last = Window.partitionBy("sid", "g").orderBy(F.col("t").desc())
    return rows.withColumn("g", day).withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin_code, destination_code, departed_at, arrived_at, duration_min."""
    start = (F.col("l_orderkey") % 96 * 15).cast("int")
    code = lambda c: F.lpad((F.col(c) % 100).cast("string"), 3, "0")
    return table(spark, sf_dir, "lineitem").select(
        code("l_suppkey").alias("origin_code"), code("l_partkey").alias("destination_code"), plus_minutes(F.col("l_shipdate"), start).alias("departed_at"),
        plus_minutes(F.col("l_shipdate"), start + F.col("l_quantity").cast("int")).alias("arrived_at"), F.col("l_quantity").alias("duration_min"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return table(spark, sf_dir, "events").groupBy(hour).agg(F.avg("value").alias("temp"), F.count(F.lit(1)).alias("precip"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed documents as JSON text, one a day: {last_updated, data: {stations: [...]}}."""
    station = F.struct(
        F.col("sid").cast("string").alias("station_id"), F.col("docks").alias("num_docks_available"), F.col("bikes").alias("num_bikes_available"),
        F.lit(1).alias("is_installed"), F.col("ok").cast("int").alias("is_returning"), F.unix_seconds(F.col("t").cast("timestamp")).alias("last_reported"),
    )
    daily = daily_readings(spark, sf_dir).groupBy("g").agg(F.sort_array(F.collect_list(station)).alias("stations"))
    updated = (F.unix_seconds(F.col("g").cast("timestamp")) + 86_400).alias("last_updated")
    return daily.select("g", F.to_json(F.struct(updated, F.struct("stations").alias("data"))).alias("document"))


FEED = (
    "last_updated long, data struct<stations: array<struct<station_id: string, num_docks_available: long, num_docks_disabled: long, "
    "num_bikes_available: long, is_installed: long, is_returning: long, last_reported: long>>>"
)


def exploded(documents: DataFrame, column: str = "document") -> DataFrame:
    """A row a station of each valid document: missing fields are null, unknown ones dropped; others than feeds give nothing."""
    doc = documents.withColumn("_d", F.from_json(column, FEED)).where("_d.last_updated is not null and size(_d.data.stations) > 0")
    return doc.select("_d.last_updated", F.explode("_d.data.stations").alias("s")).select("last_updated", "s.*")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Captured files, gzip or not, one JSON document each."""
    return exploded(spark.read.text(path, wholetext=True).withColumnRenamed("value", "document"))
