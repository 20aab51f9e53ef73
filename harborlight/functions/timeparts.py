"""Parts of local time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlight.config import PEAK_FROM, PEAK_TO, PEAK_SLOTS, SLOT_MIN


def minute_of_day(t: Column) -> Column:
    return (F.hour(t) * 60 + F.minute(t)).cast("long")


def slot(t: Column) -> Column:
    return F.floor(minute_of_day(t) / SLOT_MIN).cast("long")


def iso_weekday(t: Column) -> Column:
    return (F.weekday(t) + 1).cast("long")


def is_weekend(t: Column) -> Column:
    return F.weekday(t) >= 5


def plus_minutes(t: Column, minutes: Column | int) -> Column:
    m = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return t + F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"))


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def minutes_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / 60e6


def is_peak(t: Column) -> Column:
    """Working-day peak by minute, both ends included."""
    return ~is_weekend(t) & minute_of_day(t).between(PEAK_FROM, PEAK_TO)


def is_peak_slot(s: Column) -> Column:
    return s.between(*PEAK_SLOTS)


def on_holiday(t: Column, days: tuple[str, ...], zone: str = "UTC") -> Column:
    """Whether the day of a UTC time in the zone is one of the days."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), t.cast("timestamp_ntz"))
    return F.to_date(local).isin(*(F.to_date(F.lit(d)) for d in days))


def local_wall_clock(text: Column, pattern: str, zone: str) -> Column:
    """A wall clock in a zone to an instant: the earlier one where it comes twice, null where it doesn't exist."""
    wall = F.try_to_timestamp(text, F.lit(pattern))
    return where_it_exists(F.to_utc_timestamp(wall, zone), wall, zone)


def where_it_exists(instant: Column, wall: Column, zone: str) -> Column:
    """The instant of a wall clock, null where the clock doesn't show it."""
    return F.when(F.from_utc_timestamp(instant, zone) == wall, instant)
