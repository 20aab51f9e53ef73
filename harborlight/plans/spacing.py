"""Points thinned out: along a line from the last one kept, and in the plane from all that are kept, both by rank."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.config import EARTH_M
from harborlight.functions import geo as G
from harborlight.plans import search
from harborlight.plans import views_sql as V
from harborlight.sources.shared import saved

METRES = 100.0


def along(points: DataFrame, group: str, rank: str, metres: float) -> DataFrame:
    """points (group, rank, lat, lon) with kept: the first of each group, and each that is so far from the last one kept.

    One pass over a line's points in their order, which holds three numbers a point; lines are dealt to tasks whole, as each
    step depends on the one before.
    """

    def walked(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(rank)
        lat, lon = np.radians(part["lat"].to_numpy()), np.radians(part["lon"].to_numpy())
        kept = np.zeros(len(part), dtype=bool)
        at = 0
        while at < len(part):
            kept[at] = True
            found, step = len(part), 64
            for i in range(at + 1, len(part), step):  # looks ahead in blocks, so a pass is linear
                j = min(i + step, len(part))
                far = EARTH_M * np.hypot(lat[i:j] - lat[at], (lon[i:j] - lon[at]) * np.cos((lat[i:j] + lat[at]) / 2))
                if (far >= metres).any():
                    found = i + int(np.argmax(far >= metres))
                    break
            at = found
        return part.assign(kept=kept)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.groupBy(group).applyInPandas(walked, f"{kinds}, kept boolean")


def cell_of(metres: float) -> tuple[Column, Callable[[Column], Column]]:
    """Grid row and the column of a row: cells at least so wide and high, so near points lie in adjacent ones."""
    step = metres / (EARTH_M * 3.141592653589793 / 180) * 1.0001
    row = F.floor(F.col("lat") / step)
    width = lambda r: F.lit(step) / F.greatest(F.cos(F.radians(F.least((F.abs(r) + 2) * step, F.lit(89.0)))), F.lit(0.01))
    return row, lambda r: F.floor(F.col("lon") / width(r))


def beside(points: DataFrame, metres: float) -> DataFrame:
    """points with the cells (_row, _cell) in which something near them can lie."""
    row, column = cell_of(metres)
    rows = points.withColumn("_row", F.explode(F.array(*(row + i for i in (-1, 0, 1)))))
    return rows.withColumn("_cell", F.explode(F.array(*(column(F.col("_row")) + i for i in (-1, 0, 1)))))


def apart(points: DataFrame, group: Sequence[str], rank: str, metres: float, rounds: int = 10_000) -> DataFrame:
    """The points that greedy thinning by rank keeps: those farther than so much from every kept one of their group.

    In each round the first undecided point of each grid cell is kept if no undecided one before it is near, and what is near a
    kept one goes. A point meets the cells beside it only, so a round is linear; the rounds are as many as the longest chain of
    points that wait for each other. rank is unique in a group.
    """
    row, column = cell_of(metres)
    group = list(group)
    left = saved(points.select(*group, rank, "lat", "lon", row.alias("_row"), column(row).alias("_cell")))
    kept = None
    far = lambda: G.flat_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "_row", "_cell"]]
    for _ in range(rounds):
        if left.isEmpty():
            return kept if kept is not None else points.select(*group, rank, "lat", "lon")
        first = left.groupBy(*group, "_row", "_cell").agg(F.min_by(F.struct(rank, "lat", "lon"), rank).alias("p")).select(*group, "p.*")
        waits = beside(first, metres).alias("a").join(left.alias("b"), [*same, F.col(f"b.{rank}") < F.col(f"a.{rank}"), far() <= metres], "left_semi")
        new = saved(first.join(waits.select(*group, rank).distinct(), [*group, rank], "left_anti"))
        left = saved(left.alias("b").join(beside(new, metres).alias("a"), [*same, far() <= metres], "left_anti"))
        kept = new if kept is None else saved(kept.unionByName(new))
    raise RuntimeError(f"not thinned in {rounds} rounds")


def spaced_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """House numbers along each street, in their order, METRES from the last one kept."""
    return along(search.numbers(spark, sf_dir).select("street", "number", "lat", "lon"), "street", "number", METRES).select("street", "number", "kept")


def thinned_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """House numbers of each street, by a digest of the number, METRES from all that are kept."""
    rows = search.numbers(spark, sf_dir).select("street", "number", "lat", "lon", F.concat(F.md5(F.col("number").cast("string")), F.lit("")).alias("rank"))
    kept = apart(rows, ["street"], "rank", METRES).select("street", "rank", F.lit(True).alias("kept"))
    return rows.join(kept, ["street", "rank"], "left").select("street", "number", F.coalesce("kept", F.lit(False)).alias("kept"))


QUERIES = [spaced_numbers, thinned_numbers]


def _greedy(order: str, near: str) -> str:
    """Point by point in a street's order, with what was kept so far."""
    return V.with_views(search.NUMBERS).replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (SELECT street, number, lat, lon, row_number() OVER (PARTITION BY street ORDER BY {order}) AS k FROM numbers),
        g AS (SELECT DISTINCT street, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS number, false AS kept, CAST([] AS STRUCT(lat DOUBLE, lon DOUBLE)[]) AS held FROM o
          UNION ALL SELECT street, k, number, keep, CASE WHEN keep THEN list_append(held, {{'lat': lat, 'lon': lon}}) ELSE held END FROM (SELECT o.street, o.k, o.number, o.lat, o.lon, g.held,
            len(list_filter({near}, lambda q: 6371000.0 * sqrt(pow(radians(q.lat - o.lat), 2) + pow(radians(q.lon - o.lon) * cos(radians((q.lat + o.lat) / 2)), 2)) {'<' if '[-1:]' in near else '<='} {METRES})) = 0 AS keep
            FROM g JOIN o ON o.street = g.street AND o.k = g.k + 1))
        SELECT street, number, kept FROM g WHERE k > 0"""


SQL = {"spaced_numbers": _greedy("number", "g.held[-1:]"), "thinned_numbers": _greedy("md5(CAST(number AS VARCHAR))", "g.held")}
SQL["spacing_fold"] = f"""SELECT street, CAST(count(*) FILTER (a.kept) AS INT) AS kept, CAST(count(*) FILTER (b.kept) AS INT) AS apart, CAST(count(*) AS INT) AS "all"
        FROM ({_greedy("number", "g.held[-1:]")}) a JOIN ({_greedy("number", "g.held")}) b USING (street, number) GROUP BY 1"""
