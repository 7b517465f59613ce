"""State timelines: which state held when, from (time, state) records.

A summary is struct<timeline: array<struct<state, start, end>>, first_ts, last_ts> with runs of equal states merged; the
last run ends where the last record is. compact_state_agg keeps only durations. States are text or integers. Records
with a null time or state are left out; one time with two states is an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsmill.functions.base import Accessors, ColumnLike, col, let, value
from tsmill.functions.times import interval_after, literal_micros, micros

FOREVER = (1 << 63) - 1


def _prev(a: Column) -> Column:
    """a moved on by one place, a null in front."""
    n = F.size(a)
    return F.when(n > 0, F.concat(F.array(F.get(a, n)), F.slice(a, 1, F.greatest(n - 1, F.lit(0))))).otherwise(a)


def _zip(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def state_agg(ts: ColumnLike, state: ColumnLike) -> Column:
    t, s = micros(ts), col(state)
    records = F.array_sort(F.collect_list(F.when(t.isNotNull() & s.isNotNull(), F.struct(t.alias("ts"), s.alias("state")))))
    return of_records(records)


def of_records(records: Column) -> Column:
    """Summary of sorted records; null if there are none."""
    return let(records, _of_records)


def _of_records(records: Column) -> Column:
    pairs = _zip(records, _prev(records))
    clash = lambda p: (p["a"]["ts"] == p["b"]["ts"]) & (p["a"]["state"] != p["b"]["state"])
    begins = F.filter(pairs, lambda p: F.when(clash(p), F.raise_error(F.lit("one time has two states")).cast("boolean")).otherwise(p["b"].isNull() | (p["a"]["state"] != p["b"]["state"])))
    starts = F.transform(begins, lambda p: p["a"])
    end = F.element_at(records, -1)
    timeline = let(
        starts,
        lambda x: F.zip_with(x, F.concat(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.array(end)), lambda s, e: F.struct(s["state"].alias("state"), s["ts"].alias("start"), e["ts"].alias("end"))),
    )
    return F.when(F.size(records) > 0, F.struct(timeline.alias("timeline"), F.get(records, F.lit(0))["ts"].alias("first_ts"), end["ts"].alias("last_ts")))


def compact_state_agg(ts: ColumnLike, state: ColumnLike) -> Column:
    return compact(state_agg(ts, state))


def compact(s: ColumnLike) -> Column:
    """Durations without the timeline."""
    s = col(s)
    first, last = F.get(s["timeline"], F.lit(0))["state"], F.element_at(s["timeline"], -1)["state"]
    out = F.struct(durations(s).alias("durations"), first.alias("first_state"), last.alias("last_state"), s["first_ts"].alias("first_ts"), s["last_ts"].alias("last_ts"))
    return F.when(s.isNotNull(), out)


def durations(s: ColumnLike) -> Column:
    """array<struct<state, duration (microseconds)>>, in the order in which states first hold."""
    t = col(s)["timeline"]
    held = lambda x: F.aggregate(F.filter(t, lambda r: r["state"] == x), F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    return F.transform(F.array_distinct(F.transform(t, lambda r: r["state"])), lambda x: F.struct(x.alias("state"), held(x).alias("duration")))


def compact_duration_in(s: ColumnLike, state) -> Column:
    """Of a compact summary: an interval makes no sense there."""
    s = col(s)
    found = F.filter(s["durations"], lambda d: d["state"] == value(state))
    return F.coalesce(F.get(found, F.lit(0))["duration"], F.lit(0).cast("long"))


def compact_into_values(s: ColumnLike) -> Column:
    return F.inline(col(s)["durations"])


def rollup(summary: ColumnLike) -> Column:
    """Merge summaries that follow each other; a gap belongs to the last state before it."""
    s = col(summary)
    rows = F.array_sort(F.collect_list(F.when(s.isNotNull(), F.struct(s["first_ts"].alias("ts"), s["last_ts"].alias("te"), s["timeline"].alias("timeline")))))
    return let(rows, _roll)


def _roll(rows: Column) -> Column:
    pairs = _zip(rows, _prev(rows))
    late = lambda p: F.coalesce(p["b"]["te"] > p["a"]["ts"], F.lit(False))
    sound = F.transform(pairs, lambda p: F.when(late(p), F.raise_error(F.lit("summaries overlap in time")).cast("boolean")).otherwise(F.lit(True)))
    starts = F.flatten(F.transform(rows, lambda r: F.transform(r["timeline"], lambda x: F.struct(x["start"].alias("ts"), x["state"].alias("state")))))
    tail = F.element_at(rows, -1)
    end = F.struct(tail["te"].alias("ts"), F.element_at(tail["timeline"], -1)["state"].alias("state"))
    return F.when((F.size(rows) > 0) & F.forall(sound, lambda x: x), of_records(F.array_distinct(F.concat(starts, F.array(end)))))


# ---------------------------------------------------------------- accessors
def timeline_in(s: Column, start, interval=None) -> Column:
    """Total of a state between start and start + interval (no interval: for ever)."""
    lo = literal_micros(start)
    return lo, (lo + interval_after(lo, interval)) if interval is not None else F.lit(FOREVER)


def duration_in(s: ColumnLike, state, start=None, interval=None) -> Column:
    """Microseconds in a state, in all or between start and start + interval; 0 if it never held."""
    t = col(s)["timeline"]
    mine = F.filter(t, lambda r: r["state"] == value(state))
    if start is None:
        total = F.aggregate(mine, F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    else:
        lo, hi = timeline_in(col(s), start, interval)
        total = F.aggregate(mine, F.lit(0).cast("long"), lambda acc, r: acc + F.greatest(F.least(r["end"], hi) - F.greatest(r["start"], lo), F.lit(0).cast("long")))
    return F.coalesce(total, F.lit(0).cast("long"))


def into_values(s: ColumnLike) -> Column:
    """Rows (state, duration)."""
    return F.inline(durations(s))


into_int_values = into_values


def _times(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.struct(r["state"].alias("state"), F.timestamp_micros(r["start"]).alias("start_time"), F.timestamp_micros(r["end"]).alias("end_time")))


def timeline(s: ColumnLike) -> Column:
    """array<struct<state, start_time, end_time>>."""
    return _times(col(s)["timeline"])


def state_timeline(s: ColumnLike) -> Column:
    """Rows (state, start_time, end_time)."""
    return F.inline(timeline(s))


state_int_timeline = state_timeline


def periods(s: ColumnLike, state) -> Column:
    rows = F.filter(col(s)["timeline"], lambda r: r["state"] == value(state))
    return F.transform(rows, lambda r: F.struct(F.timestamp_micros(r["start"]).alias("start_time"), F.timestamp_micros(r["end"]).alias("end_time")))


def state_periods(s: ColumnLike, state) -> Column:
    """Rows (start_time, end_time) of one state."""
    return F.inline(periods(s, state))


def state_at(s: ColumnLike, ts) -> Column:
    """The state at a time: null before the first record; the last state holds on after the last."""
    at = literal_micros(ts)
    before = F.filter(col(s)["timeline"], lambda r: r["start"] <= at)
    return F.when(F.size(before) > 0, F.element_at(before, -1)["state"])


state_at_int = state_at


def interpolate(s: ColumnLike, start, interval, prev=None) -> Column:
    """The summary over [start, start + interval]: begun with the last state of prev, ended with its own last state."""
    s = col(s)
    lo = literal_micros(start)
    hi = lo + interval_after(lo, interval)
    t = s["timeline"]
    head = F.get(t, F.lit(0))
    if prev is None:
        begun = t
    else:
        p = col(prev)
        before = F.element_at(p["timeline"], -1)["state"]
        rest = F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
        stretched = F.concat(F.array(F.struct(head["state"].alias("state"), lo.alias("start"), head["end"].alias("end"))), rest)
        added = F.concat(F.array(F.struct(before.alias("state"), lo.alias("start"), s["first_ts"].alias("end"))), t)
        late = F.coalesce(p["last_ts"] > lo, F.lit(False))
        from_lo = F.when(late, F.raise_error(F.lit("prev must end before the interval starts")).cast("boolean")).otherwise(p.isNotNull() & (lo < s["first_ts"]))
        begun = F.when(from_lo, F.when(before == head["state"], stretched).otherwise(added)).otherwise(t)
    ended = lambda r: F.struct(r["state"].alias("state"), r["start"].alias("start"), hi.alias("end"))
    longer = lambda t: F.concat(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.array(ended(F.element_at(t, -1))))
    whole = let(begun, lambda t: F.when(hi > s["last_ts"], longer(t)).otherwise(t))
    out = let(whole, lambda t: F.struct(t.alias("timeline"), F.get(t, F.lit(0))["start"].alias("first_ts"), F.greatest(hi, s["last_ts"]).alias("last_ts")))
    return F.when(s.isNotNull(), out)


def interpolated_duration_in(s: ColumnLike, state, start, interval, prev=None) -> Column:
    return let(interpolate(s, start, interval, prev), lambda x: duration_in(x, state))


def interpolated_state_timeline(s: ColumnLike, start, interval, prev=None) -> Column:
    return F.inline(let(interpolate(s, start, interval, prev), timeline))


interpolated_state_int_timeline = interpolated_state_timeline


def interpolated_state_periods(s: ColumnLike, state, start, interval, prev=None) -> Column:
    return F.inline(let(interpolate(s, start, interval, prev), lambda x: periods(x, state)))


acc = Accessors(
    duration_in, into_values, timeline, state_timeline, periods, state_periods, state_at, interpolated_duration_in, interpolated_state_timeline,
    interpolated_state_periods, compact_duration_in, compact_into_values,
)
acc.into_int_values, acc.state_int_timeline, acc.state_at_int = acc.into_values, acc.state_timeline, acc.state_at
