"""Thinning against plain loops, and on a long street."""

import math

import numpy as np
import pytest

from harborlight.plans import spacing

SCHEMA = "street long, rank long, lat double, lon double"


def metres(p, q):
    return 6_371_000 * math.hypot(math.radians(q[2] - p[2]), math.radians(q[3] - p[3]) * math.cos(math.radians((p[2] + q[2]) / 2)))


def cloud(seed, n, streets=3, spread=0.004):
    rng = np.random.default_rng(seed)
    rank = rng.permutation(n)
    return [(int(rng.integers(streets)), int(k), 19.4 + float(rng.normal(0, spread)), -99.1 + float(rng.normal(0, spread))) for k in rank]


@pytest.mark.parametrize("seed, limit", [(1, 100.0), (2, 400.0), (3, 20.0)])
def test_apart_equals_a_loop(spark, seed, limit):
    rows = [*cloud(seed, 250), (7, 0, 19.4, -99.1), (7, 1, 19.4, -99.1), (8, 5, -60.0, 179.0)]
    kept = []
    for p in sorted(rows, key=lambda r: r[1]):
        if not any(q[0] == p[0] and metres(p, q) <= limit for q in kept):
            kept.append(p)
    got = spacing.apart(spark.createDataFrame(rows, SCHEMA), ["street"], "rank", limit).collect()
    assert sorted((r.street, r.rank) for r in got) == sorted((p[0], p[1]) for p in kept)


@pytest.mark.parametrize("seed", [4, 5])
def test_along_equals_a_loop(spark, seed):
    rows = [(s, k, 19.4 + 0.0002 * k + 0.001 * math.sin(k), -99.1 + 0.002 * math.cos(k / 3)) for s in range(2) for k in range(seed, 400)]
    expected, last = {}, {}
    for p in rows:
        expected[p[:2]] = p[0] not in last or metres(last[p[0]], p) >= 100
        if expected[p[:2]]:
            last[p[0]] = p
    got = {(r.street, r.rank): r.kept for r in spacing.along(spark.createDataFrame(rows, SCHEMA), "street", "rank", 100.0).collect()}
    assert got == expected and 0 < sum(got.values()) < len(got)


def test_a_street_of_100_000_points(spark):
    k = "cast(id * 7919 % 100000 as long)"
    rows = spark.range(100_000).selectExpr("0L AS street", f"{k} AS rank", "19.4 + id * 1e-6 AS lat", "-99.1D AS lon").selectExpr("street", "rank", "cast(lat as double) lat", "lon")
    got = sorted(r.lat for r in spacing.apart(rows, ["street"], "rank", 100.0).collect())
    gaps = np.diff(got) * math.radians(1) * 6_371_000
    assert 55 < len(got) < 112 and gaps.min() > 100 and gaps.max() <= 200.3
    along = spacing.along(rows.selectExpr("street", "100000 - rank AS rank", "19.4 + (100000 - rank) * 1e-6 AS lat", "lon").selectExpr("street", "rank", "cast(lat as double) lat", "lon"), "street", "rank", 100.0)
    assert 108 < along.where("kept").count() < 113


def test_nothing(spark):
    assert spacing.apart(spark.createDataFrame([], SCHEMA), ["street"], "rank", 1.0).count() == 0
