"""Heartbeats: when a system was alive, each heartbeat proving it so for a while.

A summary is struct<start, end, last_seen, liveness, ranges: array<struct<lo, hi>>> in microseconds. Ranges are
merged where the next heartbeat comes before the last proof ends, and end with the summary's span.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsmill.functions.base import Accessors, ColumnLike, col, let
from tsmill.functions.state import _prev, _zip
from tsmill.functions.times import interval_after, literal_micros, micros, micros_of

RANGES = "array<struct<lo: long, hi: long>>"
SCHEMA = f"struct<start: long, end: long, last_seen: long, liveness: long, ranges: {RANGES}>"


def _range(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def merge_ranges(rows: Column) -> Column:
    """Sorted array<struct<lo, hi>> with overlapping and touching ranges joined; hi may fall as lo rises."""
    empty = F.array().cast(RANGES)

    def step(acc: Column, r: Column) -> Column:
        last = acc["last"]
        joins = last.isNotNull() & (r["lo"] <= last["hi"])
        longer = _range(last["lo"], F.greatest(last["hi"], r["hi"]))
        return F.struct(
            F.when(last.isNotNull() & ~joins, F.concat(acc["done"], F.array(last))).otherwise(acc["done"]).cast(RANGES).alias("done"),
            F.when(joins, longer).otherwise(r).cast("struct<lo: long, hi: long>").alias("last"),
        )

    zero = F.struct(empty.alias("done"), F.lit(None).cast("struct<lo: long, hi: long>").alias("last"))
    joined = let(F.aggregate(rows, zero, step), lambda out: F.concat(out["done"], F.array(out["last"])))
    return F.when(F.size(rows) > 0, joined).otherwise(empty)


def islands(beats: Column, liveness: int, end: Column) -> Column:
    """Live ranges of sorted heartbeats."""
    pairs = _zip(beats, _prev(beats))
    breaks = F.filter(pairs, lambda p: p["b"].isNull() | (p["a"] > p["b"] + liveness))
    last = F.array(F.element_at(beats, -1))
    ends = F.concat(F.slice(F.transform(breaks, lambda p: p["b"]), 2, F.greatest(F.size(breaks) - 1, F.lit(0))), last)
    return F.zip_with(breaks, ends, lambda s, e: _range(s["a"], F.least(e + liveness, end)))


def heartbeat_agg(heartbeat: ColumnLike, agg_start: ColumnLike, agg_duration, liveness) -> Column:
    """The span [agg_start, agg_start + agg_duration) is the first of the group's; heartbeats outside it are an error."""
    t = micros(heartbeat)
    start = F.min(micros(agg_start))
    live = micros_of(liveness)
    end = start + interval_after(start, agg_duration)
    beats = F.array_sort(F.collect_list(t))
    return let(F.struct(beats.alias("b"), start.alias("s"), end.alias("e")), lambda r: from_beats(r["b"], r["s"], r["e"], live))


def from_beats(beats: Column, start: Column, end: Column, live: int) -> Column:
    outside = (F.get(beats, F.lit(0)) < start) | (F.element_at(beats, -1) >= end)
    out = F.struct(start.alias("start"), end.alias("end"), F.element_at(beats, -1).alias("last_seen"), F.lit(live).cast("long").alias("liveness"), islands(beats, live, end).cast(RANGES).alias("ranges")).cast(SCHEMA)
    wrong = F.when(end - start <= live, F.lit("the span must exceed the liveness")).when(outside, F.lit("a heartbeat lies outside the span"))
    return F.when(F.size(beats) > 0, F.when(wrong.isNotNull(), F.raise_error(F.coalesce(wrong, F.lit(""))).cast(SCHEMA)).otherwise(out))


def rollup(summary: ColumnLike) -> Column:
    """Merge summaries of one liveness; the span covers them all, and ranges join across them."""
    s = col(summary)
    rows = F.array_sort(F.flatten(F.collect_list(s["ranges"])))
    live = F.min(s["liveness"])
    out = F.struct(F.min(s["start"]).alias("start"), F.max(s["end"]).alias("end"), F.max(s["last_seen"]).alias("last_seen"), live.alias("liveness"), merge_ranges(rows).alias("ranges")).cast(SCHEMA)
    return F.when(F.max(s["liveness"]) != live, F.raise_error(F.lit("summaries differ in liveness")).cast(SCHEMA)).when(live.isNotNull(), out)


# ---------------------------------------------------------------- accessors
def _gaps(s: Column) -> Column:
    r = s["ranges"]
    lows = F.concat(F.array(s["start"]), F.transform(r, lambda x: x["hi"]))
    highs = F.concat(F.transform(r, lambda x: x["lo"]), F.array(s["end"]))
    return F.filter(F.zip_with(lows, highs, _range), lambda g: g["lo"] < g["hi"])


def _times(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.struct(F.timestamp_micros(r["lo"]).alias("start"), F.timestamp_micros(r["hi"]).alias("end")))


def _total(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0).cast("long"), lambda acc, r: acc + r["hi"] - r["lo"])


def live_list(s: ColumnLike) -> Column:
    return _times(col(s)["ranges"])


def live_ranges(s: ColumnLike) -> Column:
    """Rows (start, end)."""
    return F.inline(live_list(s))


def dead_list(s: ColumnLike) -> Column:
    return _times(_gaps(col(s)))


def dead_ranges(s: ColumnLike) -> Column:
    return F.inline(dead_list(s))


def uptime(s: ColumnLike) -> Column:
    """Microseconds."""
    return _total(col(s)["ranges"])


def downtime(s: ColumnLike) -> Column:
    s = col(s)
    return s["end"] - s["start"] - uptime(s)


def live_at(s: ColumnLike, ts) -> Column:
    """Whether a time lies in a live range, its end excluded; an error outside the span."""
    s = col(s)
    at = literal_micros(ts)
    inside = F.exists(s["ranges"], lambda r: (r["lo"] <= at) & (at < r["hi"]))
    return F.when((at < s["start"]) | (at > s["end"]), F.raise_error(F.lit("time outside the span")).cast("boolean")).otherwise(inside)


def interpolate(s: ColumnLike, prev: ColumnLike) -> Column:
    """The summary with what the last heartbeat of prev proves within it."""
    s, p = col(s), col(prev)
    until = F.least(p["last_seen"] + p["liveness"], s["end"])
    more = F.when(until > s["start"], F.array(_range(s["start"], until))).otherwise(F.array().cast(RANGES))
    return F.when(p.isNull(), s).otherwise(s.withField("ranges", merge_ranges(F.concat(more, s["ranges"]))))


def interpolated_uptime(s: ColumnLike, prev: ColumnLike) -> Column:
    return let(interpolate(s, prev), uptime)


def interpolated_downtime(s: ColumnLike, prev: ColumnLike) -> Column:
    return let(interpolate(s, prev), downtime)


def num_live_ranges(s: ColumnLike) -> Column:
    return F.size(col(s)["ranges"]).cast("long")


def num_gaps(s: ColumnLike) -> Column:
    return F.size(_gaps(col(s))).cast("long")


def trim_to(s: ColumnLike, start=None, duration=None) -> Column:
    """The summary cut to [start, start + duration], which must lie in its span."""
    s = col(s)
    lo = literal_micros(start) if start is not None else s["start"]
    hi = lo + interval_after(lo, duration) if duration is not None else s["end"]
    cut = F.filter(F.transform(s["ranges"], lambda r: _range(F.greatest(r["lo"], lo), F.least(r["hi"], hi))), lambda r: r["lo"] < r["hi"])
    seen = F.when(F.size(cut) > 0, F.least(s["last_seen"], F.element_at(cut, -1)["hi"])).otherwise(lo - s["liveness"])
    out = F.struct(lo.alias("start"), hi.alias("end"), F.least(s["last_seen"], seen).alias("last_seen"), s["liveness"].alias("liveness"), cut.alias("ranges")).cast(SCHEMA)
    wrong = (lo < s["start"]) | (hi > s["end"]) | (hi <= lo)
    return F.when(wrong, F.raise_error(F.lit("the new span must lie in the old one")).cast(SCHEMA)).when(s.isNotNull(), out)


def same(a: ColumnLike, b: ColumnLike) -> Column:
    return col(a) == col(b)


def different(a: ColumnLike, b: ColumnLike) -> Column:
    return ~(col(a) == col(b))


acc = Accessors(live_list, live_ranges, dead_list, dead_ranges, uptime, downtime, live_at, interpolate, interpolated_uptime, interpolated_downtime, num_live_ranges, num_gaps, trim_to)
