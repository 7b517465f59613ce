"""Counters and gauges: change over time of a measured value, with resets to zero taken into account for counters.

A summary keeps the first two and last two points, sums over resets and the two-variable sums of the adjusted value
against seconds since 2000. Rows with a null time or value are left out; of rows with equal times the one with the
smallest value counts, or with repeats all of them count, smaller values first. Here a group is folded in the order of time; tsmill.operators.series builds the same summary with
windows, which spill and need no group in memory.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsmill.functions import stats
from tsmill.functions.base import Accessors, ColumnLike, col, fold, ieee_div, let, let2, need, null
from tsmill.functions.times import EPOCH_2000, interval_after, literal_micros, micros, seconds_2000

POINT = "struct<ts: long, val: double>"
SCHEMA = (
    f"struct<first: {POINT}, second: {POINT}, penultimate: {POINT}, last: {POINT}, reset_sum: double, num_resets: long, num_changes: long, "
    "n: long, sx: double, sx2: double, sy: double, sy2: double, sxy: double, bounds: struct<lo: long, hi: long>>"
)
_SUMS = ("n", "sx", "sx2", "sy", "sy2", "sxy")


def point(ts: Column, val: Column) -> Column:
    return F.struct(ts.cast("long").alias("ts"), val.cast("double").alias("val"))


def build(first, second, penultimate, last, reset_sum, num_resets, num_changes, n, sx, sx2, sy, sy2, sxy, limits) -> Column:
    values = (first, second, penultimate, last, reset_sum, num_resets, num_changes, n, sx, sx2, sy, sy2, sxy, limits)
    names = ("first", "second", "penultimate", "last", "reset_sum", "num_resets", "num_changes", *_SUMS, "bounds")
    return F.struct(*(v.alias(k) for k, v in zip(names, values))).cast(SCHEMA)


def single(p: Column, limits: Column | None = None) -> Column:
    """The summary of one point."""
    zero = F.lit(0.0)
    whole = F.lit(0).cast("long")
    limits = limits if limits is not None else null("struct<lo: long, hi: long>")
    return build(p, p, p, p, zero, whole, whole, F.lit(1).cast("long"), seconds_2000(p["ts"]), zero, p["val"], zero, zero, limits)


def is_single(s: Column) -> Column:
    return s["first"]["ts"] == s["last"]["ts"]


def _joined(a: Column, b: Column) -> Column:
    """The smallest bounds around two."""
    lo = F.when(a["lo"].isNotNull() & b["lo"].isNotNull(), F.least(a["lo"], b["lo"]))
    hi = F.when(a["hi"].isNotNull() & b["hi"].isNotNull(), F.greatest(a["hi"], b["hi"]))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.struct(lo.alias("lo"), hi.alias("hi")))


def combine(a: Column, b: Column, resets: bool) -> Column:
    """Summary of a followed by b; an error if they overlap in time."""
    return let2(a, b, lambda x, y: _combine(x, y, resets))


def _combine(a: Column, b: Column, resets: bool) -> Column:
    down = (b["first"]["val"] < a["last"]["val"]) if resets else F.lit(False)
    shift = a["reset_sum"] + F.when(down, a["last"]["val"]).otherwise(0.0)
    n = a["n"] + b["n"]
    by = b["sy"] + b["n"] * shift
    dx, dy = b["sx"] / b["n"] - a["sx"] / a["n"], by / b["n"] - a["sy"] / a["n"]
    w = a["n"].cast("double") * b["n"] / n
    out = build(
        a["first"],
        F.when(a["n"] == 1, b["first"]).otherwise(a["second"]),
        F.when(b["n"] == 1, a["last"]).otherwise(b["penultimate"]),
        b["last"],
        shift + b["reset_sum"],
        a["num_resets"] + b["num_resets"] + F.when(down, 1).otherwise(0),
        a["num_changes"] + b["num_changes"] + (a["last"]["val"] != b["first"]["val"]).cast("long"),
        n,
        a["sx"] + b["sx"],
        a["sx2"] + b["sx2"] + w * dx * dx,
        a["sy"] + by,
        a["sy2"] + b["sy2"] + w * dy * dy,
        a["sxy"] + b["sxy"] + w * dx * dy,
        _joined(a["bounds"], b["bounds"]),
    )
    return F.when(a["last"]["ts"] >= b["first"]["ts"], F.raise_error(F.lit("summaries overlap in time")).cast(SCHEMA)).otherwise(out)


def points_of(ts: ColumnLike, val: ColumnLike) -> Column:
    """Sorted array of the points of a group."""
    us, v = micros(ts), col(val).cast("double")
    return F.sort_array(F.collect_list(F.when(us.isNotNull() & v.isNotNull(), point(us, v))))


def from_points(points: Column, limits: Column | None, resets: bool, repeats: bool = False) -> Column:
    """Summary of sorted points; null if there are none."""
    limits = limits if limits is not None else null("struct<lo: long, hi: long>")

    def step(acc: Column, p: Column) -> Column:
        down = (p["val"] < acc["last"]["val"]) if resets else F.lit(False)
        shift = acc["reset_sum"] + F.when(down, acc["last"]["val"]).otherwise(0.0)
        n = acc["n"] + 1
        x, y = seconds_2000(p["ts"]), p["val"] + shift
        # deviation from the new mean, times the old and new counts
        tx, ty = x * n - (acc["sx"] + x), y * n - (acc["sy"] + y)
        w = n.cast("double") * acc["n"]
        more = build(
            acc["first"],
            F.when(acc["n"] == 1, p).otherwise(acc["second"]),
            acc["last"],
            p,
            shift,
            acc["num_resets"] + F.when(down, 1).otherwise(0),
            acc["num_changes"] + (p["val"] != acc["last"]["val"]).cast("long"),
            n,
            acc["sx"] + x,
            acc["sx2"] + tx * tx / w,
            acc["sy"] + y,
            acc["sy2"] + ty * ty / w,
            acc["sxy"] + tx * ty / w,
            acc["bounds"],
        )
        return more if repeats else F.when(acc["last"]["ts"] == p["ts"], acc).otherwise(more)

    head = F.get(points, F.lit(0))
    return F.when(F.size(points) > 0, fold(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), single(head, limits), step))


def rollup_sorted(rows: Column, resets: bool) -> Column:
    """One summary of an array of struct<ts, s>, merged in the order of ts."""
    rest = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    return F.when(F.size(rows) > 0, fold(rest, F.get(rows, F.lit(0))["s"].cast(SCHEMA), lambda acc, r: combine(acc, r["s"], resets)))


def _ordered(summary: ColumnLike) -> Column:
    s = col(summary)
    return F.array_sort(F.collect_list(F.when(s.isNotNull(), F.struct(s["first"]["ts"].alias("ts"), s.alias("s")))))


def counter_agg(ts: ColumnLike, val: ColumnLike, limits: Column | None = None, repeats: bool = False) -> Column:
    return from_points(points_of(ts, val), limits, True, repeats)


def gauge_agg(ts: ColumnLike, val: ColumnLike, limits: Column | None = None, repeats: bool = False) -> Column:
    return from_points(points_of(ts, val), limits, False, repeats)


def rollup_counter(summary: ColumnLike) -> Column:
    """Merge counter summaries that do not overlap in time."""
    return rollup_sorted(_ordered(summary), True)


def rollup_gauge(summary: ColumnLike) -> Column:
    return rollup_sorted(_ordered(summary), False)


# ---------------------------------------------------------------- accessors, for both unless said otherwise
def delta(s: ColumnLike) -> Column:
    s = col(s)
    return s["last"]["val"] + s["reset_sum"] - s["first"]["val"]


def time_delta(s: ColumnLike) -> Column:
    """Seconds from the first point to the last."""
    s = col(s)
    return (s["last"]["ts"] - s["first"]["ts"]).cast("double") / 1e6


def rate(s: ColumnLike) -> Column:
    s = col(s)
    return delta(s) / F.when(~is_single(s), time_delta(s))


def _step(a: Column, b: Column) -> Column:
    return F.when(b["val"] >= a["val"], b["val"] - a["val"]).otherwise(b["val"])


def idelta_left(s: ColumnLike) -> Column:
    s = col(s)
    return _step(s["first"], s["second"])


def idelta_right(s: ColumnLike) -> Column:
    s = col(s)
    return _step(s["penultimate"], s["last"])


def _irate(s: Column, change: Column, a: Column, b: Column) -> Column:
    """Null for one point; between repeats of a time an infinity, or NaN where nothing changes."""
    return F.when(s["n"] > 1, ieee_div(change, (b["ts"] - a["ts"]).cast("double") / 1e6))


def irate_left(s: ColumnLike) -> Column:
    s = col(s)
    return _irate(s, idelta_left(s), s["first"], s["second"])


def irate_right(s: ColumnLike) -> Column:
    s = col(s)
    return _irate(s, idelta_right(s), s["penultimate"], s["last"])


def num_elements(s: ColumnLike) -> Column:
    return col(s)["n"]


def num_changes(s: ColumnLike) -> Column:
    return col(s)["num_changes"]


def num_resets(s: ColumnLike) -> Column:
    """Counters only."""
    return col(s)["num_resets"]


def slope(s: ColumnLike) -> Column:
    """Least-squares slope in units a second."""
    return stats.slope(col(s))


def intercept(s: ColumnLike) -> Column:
    """Value of the fitted line at the start of 2000."""
    return stats.intercept(col(s))


def corr(s: ColumnLike) -> Column:
    return stats.corr(col(s))


def zero_time(s: ColumnLike) -> Column:
    """When the fitted line meets 0."""
    x = stats.x_intercept(col(s))
    return F.timestamp_micros(((x + F.lit(float(EPOCH_2000))) * 1e6).cast("long"))


counter_zero_time = gauge_zero_time = zero_time


def first_val(s: ColumnLike) -> Column:
    return col(s)["first"]["val"]


def last_val(s: ColumnLike) -> Column:
    return col(s)["last"]["val"]


def first_time(s: ColumnLike) -> Column:
    return F.timestamp_micros(col(s)["first"]["ts"])


def last_time(s: ColumnLike) -> Column:
    return F.timestamp_micros(col(s)["last"]["ts"])


def with_bounds(s: ColumnLike, limits: Column) -> Column:
    """The summary with other bounds (see times.bounds)."""
    return col(s).withField("bounds", limits.cast("struct<lo: long, hi: long>"))


def _prometheus(method: str) -> None:
    need(method.strip().lower() == "prometheus", f"unknown method {method!r}: only prometheus")


def extrapolated_delta(s: ColumnLike, method: str = "prometheus") -> Column:
    """delta carried on to the bounds: all the way if a bound is nearer than 1.1 mean gaps, else by half a gap, and
    never to before the value would have been 0. An error without finite bounds that hold all points."""
    _prometheus(method)
    s = col(s)
    b = s["bounds"]
    valid = b.isNotNull() & b["lo"].isNotNull() & b["hi"].isNotNull() & (s["first"]["ts"] >= b["lo"]) & (s["last"]["ts"] < b["hi"])
    d, span = delta(s), time_delta(s)
    gap = span / F.when(s["n"] > 1, s["n"] - 1)
    start = (s["first"]["ts"] - b["lo"]).cast("double") / 1e6
    end = (b["hi"] - s["last"]["ts"] - 1000).cast("double") / 1e6
    to_zero = span * s["first"]["val"] / F.when(d > 0, d)
    start = F.when((d > 0) & (s["first"]["val"] >= 0), F.least(start, to_zero)).otherwise(start)
    more = lambda x: F.when(x < gap * 1.1, x).otherwise(gap / 2)
    out = F.when(~is_single(s), d * (span + more(start) + more(end)) / F.when(~is_single(s), span))
    return F.when(s.isNotNull() & ~F.coalesce(valid, F.lit(False)), F.raise_error(F.lit("bounds must be finite and hold all points")).cast("double")).otherwise(out)


def extrapolated_rate(s: ColumnLike, method: str = "prometheus") -> Column:
    _prometheus(method)
    s = col(s)
    length = s["bounds"]["hi"] - s["bounds"]["lo"] - 1000
    return extrapolated_delta(s, method) / F.when(length > 0, length.cast("double") / 1e6)


def line(a: Column, b: Column, at: Column) -> Column:
    """Value at a time on the line through two points."""
    return a["val"] + (b["val"] - a["val"]) * (at - a["ts"]).cast("double") / F.when(b["ts"] != a["ts"], (b["ts"] - a["ts"]).cast("double"))


def interpolated(s: Column, start, length, prev: Column, following: Column, resets: bool) -> Column:
    """The summary of [start, start + length) with points put on its ends from the neighbouring summaries."""
    lo = literal_micros(start)
    hi = lo + interval_after(lo, length)
    unbounded = s.withField("bounds", null("struct<lo: long, hi: long>"))

    def bridge(a: Column, b: Column, at: Column) -> Column:
        """A point at a time between a and b; a counter that falls has been reset in between."""
        a = F.struct(a["ts"].alias("ts"), F.when(a["val"] > b["val"], F.lit(0.0)).otherwise(a["val"]).alias("val")) if resets else a
        return let2(a, b, lambda x, y: single(point(at, line(x, y, at))))

    def left(s: Column) -> Column:
        return F.when(prev.isNotNull() & (s["first"]["ts"] > lo), combine(bridge(prev["last"], s["first"], lo), s, resets)).otherwise(s)

    def right(s: Column) -> Column:
        return F.when(following.isNotNull() & (s["last"]["ts"] < hi), combine(s, bridge(s["last"], following["first"], hi), resets)).otherwise(s)

    # the point at the end is read off the original values, which is what the last point of the left side is too
    return let(let(unbounded, left), right)


def interpolated_delta(s: ColumnLike, start, length, prev: ColumnLike, following: ColumnLike, resets: bool = True) -> Column:
    """delta over the whole interval; prev and following are usually lag() and lead() of the summary."""
    return let(interpolated(col(s), start, length, col(prev), col(following), resets), delta)


def interpolated_rate(s: ColumnLike, start, length, prev: ColumnLike, following: ColumnLike, resets: bool = True) -> Column:
    return let(interpolated(col(s), start, length, col(prev), col(following), resets), rate)


def gauge_interpolated_delta(s: ColumnLike, start, length, prev: ColumnLike, following: ColumnLike) -> Column:
    return interpolated_delta(s, start, length, prev, following, False)


acc = Accessors(
    delta, time_delta, rate, idelta_left, idelta_right, irate_left, irate_right, num_elements, num_changes, num_resets, slope, intercept, corr, zero_time,
    first_val, last_val, first_time, last_time, with_bounds, extrapolated_delta, extrapolated_rate, interpolated_delta, interpolated_rate, gauge_interpolated_delta,
)
acc.counter_zero_time = acc.gauge_zero_time = acc.zero_time
