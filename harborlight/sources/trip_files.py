"""Trip files whose headers change from month to month."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.functions.text import month_of_name, station_code
from harborlight.functions.timeparts import where_it_exists
from harborlight.sources.files import at

# The spellings that a field's column has had, in lower case and with underscores for spaces.
SPELLINGS = {
    "bike_id": ("bici",),
    "origin_code": ("ciclo_estacion_retiro", "ce_retiro"),
    "origin_date": ("fecha_retiro",),
    "origin_time": ("hora_retiro",),
    "destination_code": ("ciclo_estacionarribo", "ciclo_estacion_arribo", "ce_arribo"),
    "destination_date": ("fecha_arribo",),
    "destination_time": ("hora_arribo",),
}
FIELD = {spelling: field for field, spellings in SPELLINGS.items() for spelling in spellings}
#: A trip's columns in the order of the result; instants are made of a date and a time.
INSTANTS = {"departed_at": "origin", "arrived_at": "destination"}


def fields(raw: DataFrame) -> dict[str, Column]:
    """The columns of a file by field, trimmed; other columns are left out, and a missing one is an error."""
    read = {FIELD.get("_".join(c.strip("\ufeff ").lower().split())): F.trim(raw[f"`{c}`"]) for c in reversed(raw.columns)}
    if missing := sorted(set(SPELLINGS) - set(read)):
        raise ValueError(f"no column for {', '.join(missing)}")
    return read


def trips_of(raw: DataFrame, zone: str, *more: Column) -> DataFrame:
    """All-string columns to codes, instants and minutes, and more columns of the file; what can't be read is null, and years of two digits are 20yy."""
    of = fields(raw)
    day = lambda end: F.regexp_replace(of[f"{end}_date"], r"/(\d\d)$", "/20$1")
    wall = {f"_{name}": F.try_to_timestamp(F.concat_ws(" ", day(end), of[f"{end}_time"]), F.lit("d/M/yyyy H:mm:ss")) for name, end in INSTANTS.items()}
    codes = [station_code(of[f"{end}_code"]).alias(f"{end}_code") for end in INSTANTS.values()]
    rows = raw.select(of["bike_id"].alias("bike_id"), *codes, *(c.alias(n) for n, c in wall.items()), *more)
    # a step each, as a time that is parsed in an expression is parsed again wherever it is named
    rows = rows.withColumns({name: F.to_utc_timestamp(f"_{name}", zone) for name in INSTANTS})
    rows = rows.withColumns({name: where_it_exists(F.col(name), F.col(f"_{name}"), zone) for name in INSTANTS})
    minutes = F.timestamp_diff("MICROSECOND", F.col("departed_at"), F.col("arrived_at")) / 60e6
    return rows.drop(*wall).withColumn("duration_min", minutes)


def read_trips(spark: SparkSession, path: str, zone: str = "America/Mexico_City") -> DataFrame:
    """One file; bytes that aren't UTF-8 become replacement characters."""
    return trips_of(spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8"), zone)


def newest(names: DataFrame) -> DataFrame:
    """(month, name): of file names the last one, in their order, of each month that one of them names."""
    months = names.select("name", month_of_name(F.regexp_extract("name", r"([^/]*)$", 1)).alias("month"))
    return months.where("month is not null").groupBy("month").agg(F.max("name").alias("name"))


def header_of(path: str) -> tuple[str, ...]:
    """The header of a file, or of the first file of a folder; only its first line is read."""
    where, name = at(path)
    if where.get_file_info(name).type == fs.FileType.Directory:
        name = min(i.path for i in where.get_file_info(fs.FileSelector(name)) if i.base_name[0] not in "._")
    with where.open_input_stream(name) as given:
        line = io.TextIOWrapper(given, encoding="utf-8", errors="replace", newline="").readline()
    return tuple(next(csv.reader([line])))


def read_months(spark: SparkSession, paths: Sequence[str], zone: str = "America/Mexico_City") -> DataFrame:
    """Trips of several monthly files or folders and their month; of a month's files the last upload counts. Files of one header are one read."""
    named = newest(spark.createDataFrame([(p,) for p in paths], "name string")).collect()  # a row a month
    alike: dict[tuple[str, ...], list] = {}
    for row in sorted(named):
        alike.setdefault(header_of(row.name), []).append(row)
    out = None
    for header, rows in alike.items():
        schema = ", ".join(f"`{c}` string" for c in header)
        raw = spark.read.schema(schema).csv([r.name for r in rows], header=True, encoding="UTF-8")
        months = F.create_map(*(F.lit(x) for r in rows for x in (r.name.rstrip("/").rsplit("/", 1)[1], r.month)))
        path = F.col("_metadata.file_path")
        month = F.coalesce(months[F.substring_index(path, "/", -1)], months[F.substring_index(F.substring_index(path, "/", -2), "/", 1)])  # a file, or a folder's
        one = trips_of(raw, zone, month.alias("month"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no file names a month")
    return out
