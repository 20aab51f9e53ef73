"""All registered queries of the station engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harborlight.plans import bundle, city, intake, learning, live, models, planner, protocol, scoring, search, spacing, stations, trips
from harborlight.streaming import jobs, keyed

MODULES = (stations, trips, learning, planner, search, models, protocol, live, city, bundle, jobs, scoring, keyed, intake, spacing)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for m in MODULES for f in m.QUERIES}
ORACLE_SQL: dict[str, str] = {name: text for m in MODULES for name, text in m.SQL.items()}
