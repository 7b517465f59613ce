"""Candlesticks: open, high, low and close of a price with their times, volume, and the volume-weighted mean price.

All parts are native aggregates with partial aggregation. Rows with a null time or price are left out. Of equal highs or
lows the earliest counts; of equal times the smaller price is the open and the close. The volume is null as soon as one
row has none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsmill.functions.base import INF, Accessors, ColumnLike, col, value
from tsmill.functions.metrics import POINT, point
from tsmill.functions.times import micros

SCHEMA = f"struct<open: {POINT}, high: {POINT}, low: {POINT}, close: {POINT}, volume: double, vwap: double>"


def _build(o, h, lo, c, volume, vwap) -> Column:
    return F.struct(o.alias("open"), h.alias("high"), lo.alias("low"), c.alias("close"), volume.alias("volume"), vwap.alias("vwap")).cast(SCHEMA)


def candlestick(ts: ColumnLike, open: ColumnLike, high: ColumnLike, low: ColumnLike, close: ColumnLike, volume) -> Column:  # noqa: A002
    """The summary of one bar that is known already."""
    t = micros(ts)
    o, h, lo, c = (col(x).cast("double") for x in (open, high, low, close))
    v = value(volume).cast("double") if not isinstance(volume, str) else F.col(volume).cast("double")
    out = _build(point(t, o), point(t, h), point(t, lo), point(t, c), v, v * (h + lo + c) / 3)
    return F.when(t.isNotNull() & o.isNotNull() & h.isNotNull() & lo.isNotNull() & c.isNotNull(), out)


def _extremes(o, h, lo, c, ok, volume, weighted) -> Column:
    """o, h, lo, c: points of each row."""
    pick = lambda p: F.when(ok, p)
    # ordering by (time, price), (price, time): no outcome depends on the order of rows
    first = F.min(pick(F.struct(o["ts"].alias("ts"), o["val"].alias("val"))))
    last = F.min(pick(F.struct((-c["ts"]).alias("ts"), c["val"].alias("val"))))
    high = F.min(pick(F.struct((-h["val"]).alias("val"), h["ts"].alias("ts"))))
    low = F.min(pick(F.struct(lo["val"].alias("val"), lo["ts"].alias("ts"))))
    whole = F.count(F.when(ok & volume.isNull(), 1)) == 0
    out = _build(first, point(high["ts"], -high["val"]), point(low["ts"], low["val"]), point(-last["ts"], last["val"]), F.when(whole, F.sum(F.when(ok, volume))), F.when(whole, F.sum(F.when(ok, weighted))))
    return F.when(F.count(F.when(ok, 1)) > 0, out)


def candlestick_agg(ts: ColumnLike, price: ColumnLike, volume=None) -> Column:
    t, p = micros(ts), col(price).cast("double")
    v = F.lit(None).cast("double") if volume is None else (F.col(volume) if isinstance(volume, str) else value(volume)).cast("double")
    at = point(t, p)
    return _extremes(at, at, at, at, t.isNotNull() & p.isNotNull(), v, v * p)


def rollup(summary: ColumnLike) -> Column:
    s = col(summary)
    return _extremes(s["open"], s["high"], s["low"], s["close"], s.isNotNull(), s["volume"], s["vwap"])


def open(s: ColumnLike) -> Column:  # noqa: A001
    return col(s)["open"]["val"]


def high(s: ColumnLike) -> Column:
    return col(s)["high"]["val"]


def low(s: ColumnLike) -> Column:
    return col(s)["low"]["val"]


def close(s: ColumnLike) -> Column:
    return col(s)["close"]["val"]


def open_time(s: ColumnLike) -> Column:
    return F.timestamp_micros(col(s)["open"]["ts"])


def high_time(s: ColumnLike) -> Column:
    return F.timestamp_micros(col(s)["high"]["ts"])


def low_time(s: ColumnLike) -> Column:
    return F.timestamp_micros(col(s)["low"]["ts"])


def close_time(s: ColumnLike) -> Column:
    return F.timestamp_micros(col(s)["close"]["ts"])


def volume(s: ColumnLike) -> Column:
    return col(s)["volume"]


def vwap(s: ColumnLike) -> Column:
    """Null unless there is a positive volume."""
    s = col(s)
    out = s["vwap"] / F.when(s["volume"] > 0, s["volume"])
    return F.when(~F.isnan(out) & (F.abs(out) < INF), out)


acc = Accessors(open, high, low, close, open_time, high_time, low_time, close_time, volume, vwap)
