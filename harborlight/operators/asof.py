"""As-of joins with tolerance, without a range join: one union, one shuffle on the key, one sort.

Both sides go through the same window, so the cost is that of sorting left and right together; all lookups of a side
share the partitioning. Where a key has too many rows for one task and the tolerance bounds the search, forward_buckets
spreads the key over time buckets instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.functions.timeparts import micros, plus_minutes


def _looked_up(left: DataFrame, right: DataFrame, key: Sequence[str], at: Column, time: str, values: Sequence[str], forward: bool) -> DataFrame:
    """left with _hit: the struct of time and values of the nearest right row not before (after) `at`."""
    hit = F.struct(F.col(time).alias("t"), *(F.col(v) for v in values))
    rows = left.select(*key, micros(at).alias("_at"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(hit.alias("h")).schema[0].dataType).alias("_right"))
    other = right.select(*key, micros(F.col(time)).alias("_at"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), hit.alias("_right"))
    side = F.col("_left").isNotNull()  # right rows come first on ties, so equal times match
    order = [F.col("_at").desc() if forward else F.col("_at"), side]
    near = F.last("_right", ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.unionByName(other).withColumn("_hit", near).where(F.col("_left").isNotNull()).select("_left.*", "_hit")


def forward(left: DataFrame, right: DataFrame, key: Sequence[str], at: Column, time: str, values: Sequence[str]) -> DataFrame:
    """The first right row at or after `at`; null where there is none."""
    return _looked_up(left, right, key, at, time, values, True)


def backward(left: DataFrame, right: DataFrame, key: Sequence[str], at: Column, time: str, values: Sequence[str]) -> DataFrame:
    """The last right row at or before `at`; null where there is none."""
    return _looked_up(left, right, key, at, time, values, False)


def within(hit: Column, at: Column, minutes: float) -> Column:
    return F.abs(micros(hit["t"]) - micros(at)) <= int(minutes * 60e6)


def lag_values(
    df: DataFrame, right: DataFrame, key: Sequence[str], time: str, value: str, ok: str, lags: Sequence[int], tolerance: float, centered: bool, prefix: str
) -> DataFrame:
    """df with prefix{lag} for each lag: the value that long ago, null if the reading is too far off or not ok.

    Trailing looks back only; centered takes the nearer of both sides, the earlier on a tie. All lags and sides come from
    one union, one shuffle and one sort, with a short frame a lag and side. Rows are dealt by key and stretch of time, and a reading goes to each stretch that can
    see it, so no task holds a key's whole history.
    """
    frames = {f"_back{lag}": (-lag - tolerance, -lag, F.last) for lag in lags}
    if centered:
        frames |= {f"_ahead{lag}": (-lag, tolerance - lag, F.first) for lag in lags}
    both, t = framed(df, right, key, time, value, ok, frames), micros(F.col(time))

    def chosen(lag: int) -> Column:
        back, at = F.col(f"_back{lag}"), t - int(lag * 60e6)
        if not centered:
            return back["_value"]
        ahead = F.col(f"_ahead{lag}")
        return F.when(back.isNull() | (ahead["_t"] - at < at - back["_t"]), ahead["_value"]).otherwise(back["_value"])

    return both.select(*df.columns, *(chosen(lag).alias(f"{prefix}{lag}") for lag in lags))


def framed(df: DataFrame, right: DataFrame, key: Sequence[str], time: str, value: str, ok: str, frames: Mapping[str, tuple]) -> DataFrame:
    """df with a column for each frame (low, high, F.first or F.last): the first or last reading (_t, _ok, _value) from low to high
    minutes after a row's time; null without one, or if that one is not ok."""
    us = lambda minutes: int(minutes * 60e6)
    low, high = min(us(x[0]) for x in frames.values()), max(us(x[1]) for x in frames.values())
    width = max(4 * abs(low), 4 * abs(high), us(24 * 60))
    stretch = lambda t: F.floor(t / F.lit(width)).cast("long")
    t = F.col(time)
    rows = df.select(F.struct(*df.columns).alias("_left"), *key, micros(t).alias("_t")).withColumn("_stretch", stretch(F.col("_t")))
    seen = right.select(*key, micros(t).alias("_t"), F.col(ok).alias("_ok"), F.col(value).alias("_value"))
    seen = seen.select(*key, "_t", F.struct("_t", "_ok", "_value").alias("_seen"), F.explode(F.sequence(stretch(F.col("_t") - high), stretch(F.col("_t") - low))).alias("_stretch"))
    order = Window.partitionBy(*key, "_stretch").orderBy("_t")

    def nearest(low: float, high: float, pick) -> Column:
        """The reading of a frame's end, in columns of its own; one window has the frames of all."""
        x = pick("_seen", ignorenulls=True).over(order.rangeBetween(us(low), us(high)))
        return F.when(x["_ok"], x)

    both = rows.unionByName(seen, allowMissingColumns=True)
    both = both.select("*", *(nearest(*frame).alias(name) for name, frame in frames.items())).where("_left is not null")
    return both.select("_left.*", *frames)


def forward_buckets(left: DataFrame, right: DataFrame, key: Sequence[str], low: Column, high: Column, time: str, values: Sequence[str], minutes: int) -> DataFrame:
    """forward() for a bounded search: [low, high] of each left row meets right rows by key and time bucket.

    Rows of one key spread over many tasks, and all buckets of the window are looked at. Left rows without a hit, and
    repeats of a left row, don't come back.
    """
    width = int(minutes * 60e6)
    spans = F.explode(F.sequence(F.floor(micros(low) / width), F.floor(micros(high) / width)))
    asked = left.select("*", micros(low).alias("_low"), micros(high).alias("_high")).withColumn("_bucket", spans)
    there = right.select(*key, micros(F.col(time)).alias("_t"), F.floor(micros(F.col(time)) / width).alias("_bucket"), F.struct(F.col(time).alias("t"), *values).alias("_right"))
    met = asked.join(there, [*key, "_bucket"]).where(F.col("_t").between(F.col("_low"), F.col("_high")))
    return met.groupBy(*left.columns).agg(F.min_by("_right", "_t").alias("_hit"))
