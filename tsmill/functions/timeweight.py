"""Time-weighted averages and integrals, by carrying values forward (locf) or along straight lines (linear)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsmill.functions.base import Accessors, ColumnLike, col, fold, let, let2, need
from tsmill.functions.metrics import POINT, line, point, points_of
from tsmill.functions.times import interval_after, literal_micros, unit_micros

SCHEMA = f"struct<first: {POINT}, last: {POINT}, w_sum: double, method: string>"


def method_name(method: str) -> str:
    m = method.strip().lower()
    need(m in ("linear", "trapezoidal", "locf"), f"unknown method {method!r}: linear or locf")
    return "locf" if m == "locf" else "linear"


def build(first: Column, last: Column, w_sum: Column, method: Column) -> Column:
    return F.struct(first.alias("first"), last.alias("last"), w_sum.alias("w_sum"), method.alias("method")).cast(SCHEMA)


def area(a: Column, b: Column, method: Column) -> Column:
    """Value times microseconds between two points."""
    width = (b["ts"] - a["ts"]).cast("double")
    return F.when(method == "locf", a["val"] * width).otherwise((a["val"] + b["val"]) / 2 * width)


def from_points(points: Column, method: str) -> Column:
    m = F.lit(method_name(method))

    def step(acc: Column, p: Column) -> Column:
        more = build(acc["first"], p, acc["w_sum"] + area(acc["last"], p, m), m)
        return F.when(acc["last"]["ts"] == p["ts"], acc).otherwise(more)

    head = F.get(points, F.lit(0))
    rest = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    return F.when(F.size(points) > 0, fold(rest, build(head, head, F.lit(0.0), m), step))


def time_weight(method: str, ts: ColumnLike, val: ColumnLike) -> Column:
    """Rows with a null time or value are left out; of equal times the smallest value counts."""
    return from_points(points_of(ts, val), method)


def combine(a: Column, b: Column) -> Column:
    return let2(a, b, _combine)


def _combine(a: Column, b: Column) -> Column:
    out = build(a["first"], b["last"], a["w_sum"] + b["w_sum"] + area(a["last"], b["first"], a["method"]), a["method"])
    wrong = F.when(a["method"] != b["method"], F.lit("summaries differ in method")).when(a["last"]["ts"] >= b["first"]["ts"], F.lit("summaries overlap in time"))
    return F.when(wrong.isNotNull(), F.raise_error(F.coalesce(wrong, F.lit(""))).cast(SCHEMA)).otherwise(out)


def rollup(summary: ColumnLike) -> Column:
    """Merge summaries that do not overlap in time; what lies between two is weighed in by their method."""
    s = col(summary)
    rows = F.array_sort(F.collect_list(F.when(s.isNotNull(), F.struct(s["first"]["ts"].alias("ts"), s.alias("s")))))
    rest = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    return F.when(F.size(rows) > 0, fold(rest, F.get(rows, F.lit(0))["s"].cast(SCHEMA), lambda acc, r: combine(acc, r["s"])))


def average(s: ColumnLike) -> Column:
    s = col(s)
    width = s["last"]["ts"] - s["first"]["ts"]
    return s["w_sum"] / F.when(width != 0, width.cast("double"))


def integral(s: ColumnLike, unit: str = "second") -> Column:
    return col(s)["w_sum"] / F.lit(float(unit_micros(unit)))


def first_val(s: ColumnLike) -> Column:
    return col(s)["first"]["val"]


def last_val(s: ColumnLike) -> Column:
    return col(s)["last"]["val"]


def first_time(s: ColumnLike) -> Column:
    return F.timestamp_micros(col(s)["first"]["ts"])


def last_time(s: ColumnLike) -> Column:
    return F.timestamp_micros(col(s)["last"]["ts"])


def interpolated(s: ColumnLike, start, length, prev=None, following=None) -> Column:
    """The summary stretched to [start, start + length]: to the left from prev, to the right towards following; locf
    needs no following."""
    s = col(s)
    lo = literal_micros(start)
    hi = lo + interval_after(lo, length)
    m = s["method"]
    p = col(prev) if prev is not None else F.lit(None).cast(SCHEMA)
    n = col(following) if following is not None else F.lit(None).cast(SCHEMA)

    def between(a: Column, b: Column, at: Column) -> Column:
        return point(at, F.when(m == "locf", a["val"]).otherwise(line(a, b, at)))

    at_lo = between(p["last"], s["first"], lo)
    stretch = p.isNotNull() & (lo < s["first"]["ts"])
    first = F.when(stretch, at_lo).otherwise(s["first"])
    w = s["w_sum"] + F.when(stretch, let(at_lo, lambda a: area(a, s["first"], m))).otherwise(0.0)
    at_hi = F.when(m == "locf", point(hi, s["last"]["val"])).otherwise(between(s["last"], n["first"], hi))
    go_on = (m == "locf") | n.isNotNull()
    out = let2(first, at_hi, lambda f, h: build(f, F.when(go_on, h).otherwise(s["last"]), w + F.when(go_on, area(s["last"], h, m)).otherwise(0.0), m))
    outside = s.isNotNull() & ((lo > s["first"]["ts"]) | (hi <= s["last"]["ts"]))
    return F.when(outside, F.raise_error(F.lit("the interval must hold the summary")).cast(SCHEMA)).when(s.isNotNull(), out)


def interpolated_average(s: ColumnLike, start, length, prev=None, following=None) -> Column:
    return let(interpolated(s, start, length, prev, following), average)


def interpolated_integral(s: ColumnLike, start, length, prev=None, following=None, unit: str = "second") -> Column:
    return let(interpolated(s, start, length, prev, following), lambda x: integral(x, unit))


acc = Accessors(average, integral, first_val, last_val, first_time, last_time, interpolated_average, interpolated_integral)
