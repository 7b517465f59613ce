"""Times, intervals, buckets and saturating integers.

Points in time are handled as microseconds since 1970 in UTC. Intervals are given as timedelta, microseconds, or text
such as "1 day 2 hours"; months are only allowed where a calendar is at hand (time_bucket, month_normalize).
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsmill.functions.base import ColumnLike, col, value

#: 2000-01-01 in seconds since 1970: the epoch of regressions over time.
EPOCH_2000 = 946_684_800
MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
#: Other spellings of units; fixed values.
ALIASES = {
    "us": "microsecond", "usec": "microsecond", "microseconds": "microsecond", "usecs": "microsecond",
    "ms": "millisecond", "msec": "millisecond", "msecs": "millisecond", "milliseconds": "millisecond", "millis": "millisecond",
    "s": "second", "sec": "second", "secs": "second", "seconds": "second",
    "min": "minute", "mins": "minute", "minutes": "minute", "m": "minute",
    "h": "hour", "hr": "hour", "hrs": "hour", "hours": "hour",
    "d": "day", "days": "day", "w": "week", "weeks": "week",
}


def unit_micros(unit: str) -> int:
    u = unit.strip().lower()
    u = ALIASES.get(u, u)
    if u not in MICROS:
        raise ValueError(f"unknown unit of time: {unit}")
    return MICROS[u]


def split_interval(interval) -> tuple[int, int]:
    """(months, microseconds) of an interval."""
    if isinstance(interval, timedelta):
        return 0, (interval.days * 86_400 + interval.seconds) * 1_000_000 + interval.microseconds
    if isinstance(interval, int):
        return 0, interval
    text, months, micros = interval.strip().lower(), 0, 0
    if m := re.search(r"(-?)(\d+):(\d\d)(?::(\d\d(?:\.\d+)?))?$", text):
        part = (int(m[2]) * 3600 + int(m[3]) * 60 + float(m[4] or 0)) * 1e6
        micros += round(-part if m[1] else part)
        text = text[: m.start()].strip()
    found = re.findall(r"([+-]?\d+(?:\.\d+)?)\s*([a-z]+)", text)
    if not found and text and not micros or re.sub(r"[+-]?\d+(?:\.\d+)?\s*[a-z]+[\s,]*", "", text):
        raise ValueError(f"not an interval: {interval}")
    for n, unit in found:
        if unit.rstrip("s") in ("month", "mon"):
            months += int(n)
        elif unit.rstrip("s") in ("year", "y", "yr"):
            months += 12 * int(n)
        else:
            micros += round(float(n) * unit_micros(unit))
    return months, micros


def micros_of(interval) -> int:
    months, micros = split_interval(interval)
    if months:
        raise ValueError(f"months have no fixed length: {interval}")
    return micros


def flat_micros(interval) -> int:
    """Microseconds with months of 30 days."""
    months, micros = split_interval(interval)
    return micros + months * 30 * MICROS["day"]


def interval_after(start: Column, interval) -> Column:
    """Microseconds from start (microseconds) to start plus the interval; months follow the calendar."""
    if isinstance(interval, Column):
        return interval.cast("long")
    months, micros = split_interval(interval)
    if not months:
        return F.lit(micros)
    return F.unix_micros(F.timestamp_micros(start) + F.make_ym_interval(F.lit(0), F.lit(months))) - start + F.lit(micros)


def micros(ts) -> Column:
    """Microseconds since 1970 of a timestamp column or literal; numbers are taken as they are."""
    if isinstance(ts, datetime):
        d = ts if ts.tzinfo else ts.replace(tzinfo=timezone.utc)
        return F.lit((d - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1))
    if isinstance(ts, int):
        return F.lit(ts).cast("long")
    return F.unix_micros(col(ts).cast("timestamp"))


def literal_micros(ts) -> Column:
    """As micros(), a string being a point in time rather than the name of a column."""
    return F.unix_micros(F.lit(ts).cast("timestamp")) if isinstance(ts, str) else micros(ts)


def timestamp(us: Column) -> Column:
    return F.timestamp_micros(us)


def seconds_2000(us: Column) -> Column:
    return us.cast("double") / 1e6 - F.lit(float(EPOCH_2000))


def time_bucket(width, ts: ColumnLike, origin=None) -> Column:
    """Start of the bucket of ts. Without an origin, weeks begin on Monday (2000-01-03) and months with the calendar's."""
    months, us = split_interval(width)
    t = micros(ts)
    if months:
        if us:
            raise ValueError("a bucket is of months or of fixed length")
        d = F.timestamp_micros(t)
        n = F.year(d) * 12 + F.month(d) - 1
        n = n - F.pmod(n - 2000 * 12, F.lit(months))
        return F.make_date(F.floor(n / 12).cast("int"), F.pmod(n, F.lit(12)).cast("int") + 1, F.lit(1)).cast("timestamp")
    if us <= 0:
        raise ValueError("a bucket must have a length")
    start = literal_micros(origin) if origin is not None else F.lit(EPOCH_2000 * 1_000_000 + 2 * MICROS["day"])
    return F.timestamp_micros(t - F.pmod(t - start, F.lit(us)))


def time_bucket_range(width, ts: ColumnLike) -> Column:
    """struct<lo, hi>: the bucket of ts as a half-open range."""
    lo = time_bucket(width, ts)
    months, us = split_interval(width)
    hi = lo + F.make_ym_interval(F.lit(0), F.lit(months)) if months else F.timestamp_micros(F.unix_micros(lo) + us)
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def bounds(lo=None, hi=None, lo_inclusive: bool = True, hi_inclusive: bool = False) -> Column:
    """struct<lo: long, hi: long>, half open, in microseconds; None is unbounded; an empty range is null."""
    a = F.lit(None).cast("long") if lo is None else literal_micros(lo) + (0 if lo_inclusive else 1)
    b = F.lit(None).cast("long") if hi is None else literal_micros(hi) + (1 if hi_inclusive else 0)
    out = F.struct(a.alias("lo"), b.alias("hi"))
    return F.when(F.coalesce(b <= a, F.lit(False)), F.lit(None)).otherwise(out)


def to_epoch(ts: ColumnLike) -> Column:
    """Seconds since 1970."""
    return micros(ts).cast("double") / 1e6


def as_interval(us: Column) -> Column:
    """Microseconds, as durations are given by this library, as a day-time interval."""
    return F.make_dt_interval(secs=(us / F.lit(1_000_000)).cast("decimal(18,6)"))


def days_in_month(ts: ColumnLike) -> Column:
    return F.dayofmonth(F.last_day(col(ts).cast("timestamp").cast("date"))).cast("int")


def month_normalize(metric: ColumnLike, reference: ColumnLike, days: float = 365.25 / 12) -> Column:
    """A month's total as that of a month of `days` days; the month has the days from reference to a month later."""
    ref = col(reference).cast("timestamp")
    length = F.datediff(F.add_months(ref.cast("date"), 1), ref.cast("date"))
    return col(metric).cast("double") * F.lit(float(days)) / length


# ---------------------------------------------------------------- 32-bit integers that stay in range
_LOW, _HIGH = -(1 << 31), (1 << 31) - 1


def _clamp(x: Column, low: int = _LOW) -> Column:
    return F.least(F.greatest(x, F.lit(low).cast("long")), F.lit(_HIGH).cast("long")).cast("int")


def _long(x) -> Column:
    return (col(x) if isinstance(x, str) else value(x)).cast("long")


def saturating_add(x, y) -> Column:
    return _clamp(_long(x) + _long(y))


def saturating_add_pos(x, y) -> Column:
    """The sum, 0 at least."""
    return _clamp(_long(x) + _long(y), 0)


def saturating_sub(x, y) -> Column:
    return _clamp(_long(x) - _long(y))


def saturating_sub_pos(x, y) -> Column:
    """The difference, 0 at least."""
    return _clamp(_long(x) - _long(y), 0)


def saturating_mul(x, y) -> Column:
    return _clamp(_long(x) * _long(y))
