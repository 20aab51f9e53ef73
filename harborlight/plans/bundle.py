"""The serving bundle: what live scoring and planning need, as one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.plans import stations, trips
from harborlight.plans.live import fresh_folder
from harborlight.sources.shared import saved

#: Queries whose results the bundle holds; their sizes are those of stations, pairs of stations and slots.
PARTS = {f.__name__: f for f in (trips.net_flow, trips.ride_times, stations.station_codes, stations.station_profile)}


def store(tables: dict[str, DataFrame], facts: DataFrame, folder: str) -> None:
    """A Parquet folder a table, and facts as JSON with a list by station and key. The manifest comes last: a folder without it is incomplete."""
    spark = facts.sparkSession
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}")
    facts.write.json(f"{folder}/facts")
    spark.createDataFrame([(n,) for n in tables], "name string").coalesce(1).write.json(f"{folder}/manifest")


def load(spark: SparkSession, folder: str, facts: str) -> tuple[dict[str, DataFrame], DataFrame]:
    names = [r.name for r in spark.read.schema("name string").json(f"{folder}/manifest").collect()]  # a row a table
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}, spark.read.schema(facts).json(f"{folder}/facts")


def digest_of(rows: DataFrame) -> str:
    """The number of rows and the sum of their digests: the same for the same rows in any order."""
    columns = [F.to_json(c) if kind.startswith(("map", "variant")) else F.col(c) for c, kind in rows.dtypes]
    return str(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first())


def bundle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each table of a stored bundle has, and the facts (flows by station and slot), and whether they are the rows that were stored."""
    folder = fresh_folder(spark, "bundle")
    tables = {name: saved(f(spark, sf_dir)) for name, f in PARTS.items()}
    facts = tables["net_flow"].groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))
    store(tables, facts, folder)
    held, again = load(spark, folder, "station_id string, n long")
    same = lambda a, b: F.lit(digest_of(a) == digest_of(b.select(*a.columns))).alias("same")
    out = again.agg(F.sum("n").alias("n")).select(F.lit("facts").alias("name"), "n", same(facts, again))
    for name, rows in held.items():
        out = out.unionByName(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n", same(tables[name], rows)))
    return out


QUERIES = [bundle_roundtrip]
_SQL = trips.SQL | stations.SQL
SQL = {
    "bundle_roundtrip": " UNION ALL ".join(f"SELECT '{n}' AS name, CAST(count(*) AS BIGINT) AS n, true AS same FROM ({_SQL[q]})" for n, q in [("facts", "net_flow"), *zip(PARTS, PARTS)]),
}
