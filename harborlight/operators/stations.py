"""Labels, station graph, neighbour state and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.config import EARTH_M, NEIGHBOUR_M, STALE_AFTER_S
from harborlight.functions.geo import haversine_m
from harborlight.functions.timeparts import is_peak

#: In-service and target predicates by target.
TARGETS = {"full": ("is_installed AND is_returning", "num_docks_available = 0"), "empty": ("is_installed", "num_bikes_available = 0")}


def label(in_service: Column, age_s: Column, full: Column) -> Column:
    """unavailable before stale (no age, or more than three hours) before full before available."""
    stale = F.coalesce(age_s, F.lit(STALE_AFTER_S + 1)) > STALE_AFTER_S
    return F.when(~in_service, "unavailable").when(stale, "stale").when(full, "full").otherwise("available")


def recommendable(name: Column) -> Column:
    return name.isin("available", "full")


def places(readings: DataFrame) -> DataFrame:
    """A station's mean place and dense code, in the order of sid; the ranking runs over stations, not readings."""
    mean = readings.groupBy("sid").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return mean.withColumn("station", F.row_number().over(Window.orderBy("sid")).cast("long") - 1)


def near_points(points: DataFrame, stations: DataFrame, metres: float) -> DataFrame:
    """points (lat, lon and what else) with each station (b, lat_b, lon_b) within the distance, and metres.

    An equi join on grid cells and their neighbours, not all pairs. A station near the date line has a cell on its other side
    as well; where cells are wider than a third of the circle, a row is one.
    """
    step = metres / (EARTH_M * 3.141592653589793 / 180)
    row = lambda lat: F.floor(F.col(lat) / step)
    # a row's cells are as wide as its far edge needs, so neighbours lie in adjacent columns of the row
    width = F.lit(step) / F.greatest(F.cos(F.radians(F.least((F.abs("_row") + 2) * step, F.lit(89.0)))), F.lit(0.01))
    width = F.when(width > 120, F.lit(1000.0)).otherwise(width)
    asked = points.withColumn("_row", F.explode(F.array(*(row("lat") + i for i in (-1, 0, 1)))))
    asked = asked.withColumn("_cell", F.explode(F.array(*(F.floor(F.col("lon") / width) + i for i in (-1, 0, 1)))))
    there = stations.select(F.col("sid").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), row("lat").alias("_row"))
    cell = lambda lon: F.floor(lon / width)
    lon, narrow = F.col("lon_b"), width < 1000
    cells = F.array(cell(lon), F.when(narrow & (lon > 180 - width), cell(lon - 360)), F.when(narrow & (lon < width - 180), cell(lon + 360)))
    met = asked.join(there.withColumn("_cell", F.explode(F.array_compact(cells))), ["_row", "_cell"]).drop("_row", "_cell")
    return met.withColumn("metres", haversine_m(F.col("lat"), F.col("lon"), F.col("lat_b"), F.col("lon_b"))).where(F.col("metres") <= metres)


def neighbours(stations: DataFrame, metres: float = NEIGHBOUR_M) -> DataFrame:
    """(a, b, metres) of stations within the distance, both ways."""
    here = stations.select(F.col("sid").alias("a"), "lat", "lon")
    return near_points(here, stations, metres).where("a <> b").select("a", "b", "metres")


def neighbour_state(edges: DataFrame, grid: DataFrame) -> DataFrame:
    """Of each station and shared time g: nb_n, nb_full_frac (out of service counts as not full), nb_occupancy_mean, nb_docks_sum."""
    full = (F.col("ok") & F.col("is_full")).cast("double")
    occupancy = 1 - F.col("docks") / F.nullif(F.col("capacity"), F.lit(0))
    state = grid.select(F.col("sid").alias("b"), "g", full.alias("f"), occupancy.alias("o"), "docks")
    return edges.join(state, "b").groupBy(F.col("a").alias("sid"), "g").agg(
        F.count(F.lit(1)).alias("nb_n"), F.avg("f").alias("nb_full_frac"), F.avg("o").alias("nb_occupancy_mean"), F.sum("docks").alias("nb_docks_sum")
    )


def profile(readings: DataFrame) -> DataFrame:
    """A station's share of full readings, over all and at peak, of those in service."""
    full = F.col("is_full").cast("double")
    return readings.where("ok").groupBy("sid").agg(F.avg(full).alias("st_full_rate"), F.avg(F.when(is_peak(F.col("t")), full)).alias("st_peak_full_rate"))


def gaps(times: DataFrame, column: str = "t") -> DataFrame:
    """(t, gap_min): minutes since the time before, over all different times; no window holds more than a day.

    The first time of a day looks at the last of the latest day before, which a window over days finds.
    """
    day = F.to_date(column)
    t = times.select(F.col(column).alias("t"), day.alias("day")).distinct()
    days = t.groupBy("day").agg(F.max("t").alias("last")).withColumn("before", F.lag("last").over(Window.orderBy("day"))).select("day", "before")
    within = F.lag("t").over(Window.partitionBy("day").orderBy("t"))
    known = t.withColumn("prev", within).join(days, "day").withColumn("prev", F.coalesce("prev", "before"))
    return known.select("t", ((F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.col("prev").cast("timestamp"))) / 60e6).alias("gap_min"))
