"""Time arithmetic on timestamp columns (with or without time zone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_epoch(seconds: Column, tz_shift: str | None = None) -> Column:
    """Epoch seconds as a timestamp, shifted into a time zone if one is named."""
    ts = F.timestamp_seconds(seconds)
    return F.from_utc_timestamp(ts, tz_shift) if tz_shift else ts


def iso_to_timestamp(text: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ``; null if malformed."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def minutes_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(60.0)


def day(ts: Column) -> Column:
    return F.to_date(ts)


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)).cast("int")


def clock(seconds: Column) -> Column:
    """Seconds of the day as ``HH:mm:ss``."""
    part = lambda c: F.lpad(c.cast("string"), 2, "0")
    whole = seconds.cast("int")
    return F.concat_ws(":", part(F.floor(whole / 3600)), part(F.floor(whole % 3600 / 60)), part(whole % 60))


def bucket_start(ts: Column, minutes: int, offset: int = 0) -> Column:
    """Start of the ``minutes`` window that holds ``ts``, with windows starting ``offset`` minutes off the hour."""
    return F.window(ts, f"{minutes} minutes", f"{minutes} minutes", f"{offset} minutes")["start"]


def slot_of_day(ts: Column, minutes: int) -> Column:
    """Number of the slot of ``minutes`` within the day, counted as whole slots an hour."""
    if not 0 < minutes <= 60:
        raise ValueError(f"minutes must be above 0 and at most 60: {minutes}")
    return F.hour(ts) * (60 // minutes) + F.floor(F.minute(ts) / minutes).cast("int")


def quarter_index(ts: Column) -> Column:
    """Quarter of an hour since midnight."""
    return F.floor(seconds_of_day(ts) / 900).cast("int")


def fractional_hour(ts: Column) -> Column:
    return seconds_of_day(ts) / F.lit(3600.0)


def slot_one_hot(ts: Column, first_hour: int, hours: int) -> list[Column]:
    """One 0/1 column for each quarter from ``first_hour`` on."""
    slot = F.floor((fractional_hour(ts) - first_hour) * 4)
    return [F.when(slot == k, 1).otherwise(0).alias(f"slot_{k}") for k in range(4 * hours)]


def is_weekday(ts: Column) -> Column:
    return F.weekday(ts) < 5


def between_hours(ts: Column, start: int, end: int) -> Column:
    """Whole hours, end excluded."""
    return (F.hour(ts) >= start) & (F.hour(ts) < end)


def between_clocks(ts: Column, start: int, end: int, strict: bool = False) -> Column:
    """Seconds of the day in [start, end), or strictly between."""
    s = seconds_of_day(ts)
    return ((s > start) if strict else (s >= start)) & (s < end)


def to_zone(ts: Column, zone: str = "Europe/Paris") -> Column:
    return F.from_utc_timestamp(ts, zone)
