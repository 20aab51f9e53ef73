"""Distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlight.config import EARTH_M, WALK_KMH, DETOUR


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_M * F.asin(F.sqrt(h))


def flat_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance, good within a city."""
    return EARTH_M * F.hypot(F.radians(lat2 - lat1), F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)))


def walk_minutes(metres: Column) -> Column:
    return metres * DETOUR / (WALK_KMH * 1000 / 60)


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float, margin: float = 0.0) -> Column:
    return lat.between(south - margin, north + margin) & lon.between(west - margin, east + margin)


def nearest_on_polyline(lat: Column, lon: Column, points: Column) -> Column:
    """Least flat distance from a point to the segments of an array of struct<lat, lon>."""
    scale = F.cos(F.radians(lat))
    x, y = (lambda p: F.radians(p["lon"] - lon) * scale * EARTH_M), (lambda p: F.radians(p["lat"] - lat) * EARTH_M)

    def gap(p: Column, q: Column) -> Column:
        dx, dy = x(q) - x(p), y(q) - y(p)
        length = dx * dx + dy * dy
        at = F.when(length > 0, F.least(F.greatest(-(x(p) * dx + y(p) * dy) / F.nullif(length, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return F.hypot(x(p) + at * dx, y(p) + at * dy)

    ends = F.slice(points, F.lit(2), F.size(points))
    starts = F.slice(points, F.lit(1), F.size(points) - 1)
    return F.array_min(F.zip_with(starts, ends, gap))
