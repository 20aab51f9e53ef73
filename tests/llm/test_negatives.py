"""Hard negatives against a plain search, with cells so small that annuli are scanned in several rounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlight.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=50, positives=5, hard=3, low=50, high=95):
    there = []
    for vec_id, e, label in rows:
        if label is not None and e is not None and all(v is not None and math.isfinite(v) for v in e):
            there.append((vec_id, [min(max(math.floor(256 * v), -(1 << 63)), (1 << 63) - 1) for v in e], label))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for i, (anchor, q, label) in enumerate(there):
        if anchor is None or anchor % every:
            continue
        scores = [(min(max(sum(a * b for a, b in zip(q, x)), -(1 << 63)), (1 << 63) - 1), vec_id, lab) for j, (vec_id, x, lab) in enumerate(there) if j != i and len(x) == len(q)]
        for s, positive, _ in sorted((x for x in scores if x[2] == label), key=order)[:positives]:
            fit = sorted((x for x in scores if x[2] != label and low * s <= 100 * x[0] <= high * s), key=order)[:hard]
            out += [(anchor, positive, k, n, s, t) for k, (t, n, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


def got(spark, rows, every=50, **more):
    found = negatives.mined(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def vectors(n, d, seed, labels=4, spread=0.4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(labels, d))
    label = rng.integers(0, labels, n)
    x = centers[label] * (1 - spread) + rng.normal(size=(n, d)) * spread
    return [(i, [float(v) for v in e], int(k)) for i, (e, k) in enumerate(zip(x, label))]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("PIECE", 64), ("CELL", 16), ("SAMPLE", 256), ("CHUNK", 8), ("FIRST", 32), ("GROWTH", 2)):
        monkeypatch.setattr(negatives, name, value)


@pytest.mark.parametrize("d, seed, spread", [(2, 1, 0.5), (3, 2, 0.9), (16, 3, 0.7)])
def test_equals_plain_in_several_rounds(spark, small, monkeypatch, d, seed, spread):
    rounds = []
    real = negatives.asking
    monkeypatch.setattr(negatives, "asking", lambda *a: rounds.append(a[3]) or real(*a))
    rows = vectors(700, d, seed, spread=spread)
    found = got(spark, rows)
    assert found == plain(rows) and len(found) > 20 and max(rounds) >= 2


def test_bounds_hold_and_leave_cells_out(spark, small):
    rows = negatives.integers(spark.createDataFrame(vectors(900, 2, 6), SCHEMA))
    keys = negatives.keys_of(rows)
    store = negatives.stored(rows, keys)
    cells = negatives.directory(store, keys)
    assert sum(c.rows.sum() for c in cells.values()) == 900
    anchors = rows.where("vec_id % 50 = 0").withColumns({c: F.array().cast("array<bigint>") for c in ("wanted", "held")})
    asks = negatives.asking(anchors, keys, cells, 0, 50, 95).collect()
    held = {}
    for r in store.collect():
        held.setdefault(r.cell, []).append(np.array(r.x, dtype=float))
    asked = 0
    for a in asks:
        asked += sum(len(held[c]) for c in a.ask)
        for c, xs in held.items():
            if c not in a.ask:
                assert max(float(np.dot(a.x, x)) for x in xs) <= a.bound
    assert asked < 0.5 * 900 * len(asks)  # annuli, not all rows


def test_ties_repeats_nulls_and_lengths(spark, small):
    rows = vectors(150, 2, 9) + vectors(40, 3, 10)
    rows += [(50, rows[50][1], rows[50][2]), (None, rows[3][1], 1), (None, rows[3][1], 2), (1_000, None, 1), (1_050, [1.0, None], 1), (1_100, [1.0, float("nan")], 1)]
    rows += [(1_150, [1.0, float("inf")], 2), (1_200, [1.0, 1.0], None), (1_250, [], 1), (1_251, [], 2), (1_252, [], 1), (-50, [0.0, 0.0], 0)]
    rows += [(2_000 + i, [0.5, 0.25], i % 3) for i in range(120)] + [(2_500, [9e11, 3.0], 1), (2_501, [9e11, 2.0], 1), (2_502, [5e11, 1.0], 2), (2_503, [4e17, 1.0], 1)]
    assert got(spark, rows) == plain(rows)


def test_other_numbers_and_default_sizes(spark):
    rows = vectors(300, 4, 11)
    assert got(spark, rows, 20, positives=2, negatives=4, low=10, high=80) == plain(rows, 20, 2, 4, 10, 80)
    assert got(spark, []) == [] and got(spark, [(50, [1.0], 1)]) == []


def test_one_vector_in_a_third_of_the_rows(spark, small):
    rows = vectors(400, 3, 12) + [(1_000 + i, [0.2, 0.4, 0.1], i % 2) for i in range(200)]
    assert got(spark, rows) == plain(rows)
