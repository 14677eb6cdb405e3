"""Dates as epoch milliseconds and as ISO strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c

PARTS = (
    "millennium", "century", "decade", "year", "quarter", "month", "day", "hour", "minute", "second", "millisecond",
    "week", "day_of_week", "dow", "day_of_year", "doy", "iso_week", "iso_year", "iso_dow", "timezone",
)


def from_millis(ms) -> Column:
    return F.timestamp_millis(_c(ms).cast("long"))


def to_millis(ts) -> Column:
    return F.unix_millis(_c(ts).cast("timestamp"))


def part_of(ts: Column, part: str) -> Column:
    """One component of a timestamp, in the session's time zone."""
    year = F.year(ts)
    made = {
        "millennium": lambda: F.ceil(year / 1000),
        "century": lambda: F.ceil(year / 100),
        "decade": lambda: F.floor(year / 10),
        "year": lambda: year,
        "quarter": lambda: F.quarter(ts),
        "month": lambda: F.month(ts),
        "day": lambda: F.dayofmonth(ts),
        "hour": lambda: F.hour(ts),
        "minute": lambda: F.minute(ts),
        "second": lambda: F.second(ts),
        "millisecond": lambda: F.pmod(F.unix_millis(ts), F.lit(1000)),
        "week": lambda: F.ceil(F.dayofyear(ts) / 7),
        "day_of_week": lambda: F.dayofweek(ts) - 1,
        "dow": lambda: F.dayofweek(ts) - 1,
        "day_of_year": lambda: F.dayofyear(ts),
        "doy": lambda: F.dayofyear(ts),
        "iso_week": lambda: F.weekofyear(ts),
        "iso_year": lambda: F.year(F.date_add(F.date_trunc("week", ts).cast("date"), 3)),
        "iso_dow": lambda: F.weekday(ts) + 1,
        "timezone": lambda: F.lit(0),
    }
    return made[part]().cast("long")


def date_part_millis(ms, part: str) -> Column:
    return part_of(from_millis(ms), part)


def date_part_str(s, part: str) -> Column:
    return part_of(F.try_to_timestamp(_c(s)), part)


_FACTOR = {"millennium": (12000, "month"), "century": (1200, "month"), "decade": (120, "month"), "year": (12, "month"), "quarter": (3, "month"), "month": (1, "month"), "week": (7, "day"), "day": (1, "day"), "hour": (3600000, "ms"), "minute": (60000, "ms"), "second": (1000, "ms"), "millisecond": (1, "ms")}


def date_add_millis(ms, n, part: str) -> Column:
    factor, unit = _FACTOR[part]
    ms, n = _c(ms).cast("long"), _c(n).cast("long") * factor
    if unit == "ms":
        return ms + n
    if unit == "day":
        return ms + n * 86_400_000
    ts = from_millis(ms)
    moved = F.add_months(ts.cast("date"), n.cast("int")).cast("timestamp")
    return F.unix_millis(moved) + (ms - F.unix_millis(F.date_trunc("day", ts)))


def str_to_millis(s) -> Column:
    return F.unix_millis(F.try_to_timestamp(_c(s)))


def millis_to_str(ms, form: str = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") -> Column:
    return F.date_format(from_millis(ms), form)


def date_format_str(s, form: str) -> Column:
    return F.date_format(F.try_to_timestamp(_c(s)), form)


def date_diff_millis(a, b, part: str) -> Column:
    """Whole parts from b to a."""
    factor, unit = _FACTOR[part]
    if unit == "month":
        months = F.months_between(from_millis(a), from_millis(b))
        whole = F.when(months < 0, F.ceil(months)).otherwise(F.floor(months))
        return F.call_function("div", whole.cast("long"), F.lit(factor).cast("long"))
    size = factor * 86_400_000 if unit == "day" else factor
    return F.call_function("div", (_c(a) - _c(b)).cast("long"), F.lit(size).cast("long"))


def date_trunc_millis(ms, part: str) -> Column:
    return F.unix_millis(F.date_trunc(part, from_millis(ms)))


def now_str() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
