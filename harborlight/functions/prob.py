"""Probabilities: scores, interpolation and calibration maps as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlight.config import EPS


def clip(p: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(p, F.lit(low)), F.lit(high))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y.cast("double"), 2))


def log_loss(p: Column, y: Column) -> Column:
    q = clip(p, EPS, 1 - EPS)
    return -F.avg(F.when(y, F.ln(q)).otherwise(F.ln(1 - q)))


def skill(score: Column, reference: Column) -> Column:
    """1 - score / reference; null where the reference isn't positive."""
    return F.when(reference > 0, 1 - score / F.nullif(reference, F.lit(0.0)))


def bin_of(p: Column, bins: int = 10) -> Column:
    return F.least(F.greatest(F.floor(p * bins), F.lit(0)), F.lit(bins - 1)).cast("long")


def at_minutes(minutes: Column, horizons: Sequence[int], values: Sequence[Column]) -> Column:
    """Linear between the horizons, the end values outside."""
    out = F.when(minutes <= horizons[0], values[0])
    for (h0, v0), (h1, v1) in zip(zip(horizons, values), zip(horizons[1:], values[1:])):
        out = out.when(minutes <= h1, v0 + (v1 - v0) * (minutes - h0) / float(h1 - h0))
    return out.otherwise(values[-1])


def ramp(p: Column, walk: Column, horizon: float = 15.0) -> Column:
    return p * clip(walk / horizon)


def heuristic(now: Column, base: Column, minutes: Column, full_after: float = 45.0) -> Column:
    """From the present state to the base rate as the horizon grows."""
    share = clip(minutes / full_after)
    return now.cast("double") * (1 - share) + base * share


def logit(p: Column) -> Column:
    q = clip(p, EPS, 1 - EPS)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def along(p: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear through knots in arrays, xs rising, the end values outside; how an isotonic fit predicts. p itself without knots."""
    below = F.size(F.filter(xs, lambda x: x <= p))
    x0, x1, y0, y1 = F.get(xs, below - 1), F.get(xs, below), F.get(ys, below - 1), F.get(ys, below)
    inside = y0 + (y1 - y0) * (p - x0) / F.nullif(x1 - x0, F.lit(0.0))
    return F.when(F.coalesce(F.size(xs), F.lit(0)) <= 0, p).when(below == 0, F.get(ys, F.lit(0))).when(below >= F.size(xs), y0).otherwise(F.coalesce(inside, y0))


def band(p: Column) -> Column:
    return F.when(p > 0.99, ">99 %").when(p < 0.01, "<1 %").otherwise(F.concat(F.round(p * 100).cast("int").cast("string"), F.lit(" %")))
