"""Summaries of ordered series built with windows: no group is held in memory, sorts spill, and a series that dominates
can be cut into slices of time that are summarised apart and then merged.

The structs are those of tsmill.functions.metrics, timeweight, state and heartbeat, so all their accessors apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsmill.functions import heartbeat as hb
from tsmill.functions import metrics, timeweight
from tsmill.functions import state as st
from tsmill.functions.base import ColumnLike, col, null, own_keys
from tsmill.functions.times import interval_after, micros, micros_of, seconds_2000


def _partition(keys: list[str]) -> list:
    return list(keys) or [F.lit(0)]


def _by(df: DataFrame, keys: list[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def _points(df: DataFrame, keys: list[str], ts: ColumnLike, val: ColumnLike, slice, repeats: bool = False) -> tuple[DataFrame, list[str], Window]:
    """keys, t, v and the neighbours' t and v; one row for each time, or with repeats all of them, smaller values first;
    split by slice of time if one is given."""
    rows = df.select(*keys, micros(ts).alias("t"), col(val).cast("double").alias("v")).where("t is not null and v is not null")
    parts = list(keys)
    if slice is not None:
        rows = rows.withColumn("slice", F.floor(F.col("t") / micros_of(slice)))
        parts.append("slice")
    w = Window.partitionBy(*_partition(parts)).orderBy("t", "v")
    if not repeats:
        rows = rows.withColumn("pt", F.lag("t").over(w)).where(F.col("pt").isNull() | (F.col("pt") != F.col("t")))
    return rows.withColumns({"pt": F.lag("t").over(w), "pv": F.lag("v").over(w), "nt": F.lead("t").over(w), "nv": F.lead("v").over(w)}), parts, w


def _linked(rows: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """rows of _points() in slices, with the neighbours that lie in other slices put in: a table with one row for each
    group and slice tells them."""
    if parts == list(keys):
        return rows
    edges = rows.groupBy(*parts).agg(F.min("t").alias("t1"), F.min_by("v", "t").alias("v1"), F.max("t").alias("t2"), F.max_by("v", "t").alias("v2"))
    w = Window.partitionBy(*_partition(keys)).orderBy("slice")
    around = edges.select(*(F.col(p).alias(f"_{p}") for p in parts), F.lag("t2").over(w).alias("lt"), F.lag("v2").over(w).alias("lv"), F.lead("t1").over(w).alias("ft"), F.lead("v1").over(w).alias("fv"))
    joined = rows.join(around, [rows[p].eqNullSafe(around[f"_{p}"]) for p in parts])
    return joined.withColumns({"pt": F.coalesce("pt", "lt"), "pv": F.coalesce("pv", "lv"), "nt": F.coalesce("nt", "ft"), "nv": F.coalesce("nv", "fv")})


def _only(test: Column, x: str | Column) -> Column:
    return F.max(F.when(test, F.col(x) if isinstance(x, str) else x))


def _metric(df: DataFrame, keys: list[str], ts: ColumnLike, val: ColumnLike, resets: bool, limits: Column | None, slice, name: str, repeats: bool) -> DataFrame:
    rows, parts, w = _points(df, keys, ts, val, slice, repeats)
    down = F.when(F.col("v") < F.col("pv"), F.col("pv")) if resets else null()
    rows = rows.withColumn("down", down)
    shift = F.coalesce(F.sum("down").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0.0)) if resets else F.lit(0.0)
    rows = rows.withColumns({"y": F.col("v") + shift, "x": seconds_2000(F.col("t"))})
    head, tail = F.col("pt").isNull(), F.col("nt").isNull()
    n = F.count("*").cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    got = _by(rows, parts).agg(
        _only(head, "t").alias("t1"), _only(head, "v").alias("v1"), _only(tail, "t").alias("t2"), _only(tail, "v").alias("v2"),
        _only(head, F.coalesce("nt", "t")).alias("t3"), _only(head, F.coalesce("nv", "v")).alias("v3"),
        _only(tail, F.coalesce("pt", "t")).alias("t4"), _only(tail, F.coalesce("pv", "v")).alias("v4"),
        zero(F.sum("down")).alias("reset_sum"), F.count("down").alias("num_resets"), F.count(F.when(F.col("v") != F.col("pv"), 1)).alias("num_changes"),
        n.alias("n"), F.sum("x").alias("sx"), zero(F.var_pop("x") * n).alias("sx2"), F.sum("y").alias("sy"), zero(F.var_pop("y") * n).alias("sy2"), zero(F.covar_pop("x", "y") * n).alias("sxy"),
    ).where("n > 0")
    point = lambda k: metrics.point(F.col(f"t{k}"), F.col(f"v{k}"))
    bounds = limits if limits is not None else null("struct<lo: long, hi: long>")
    s = metrics.build(point(1), point(3), point(4), point(2), *(F.col(c) for c in ("reset_sum", "num_resets", "num_changes", "n", "sx", "sx2", "sy", "sy2", "sxy")), bounds)
    out = got.select(*parts, s.alias(name))
    if slice is None:
        return out
    roll = metrics.rollup_counter if resets else metrics.rollup_gauge
    return _by(out, keys).agg(roll(name).alias(name))


@own_keys
def counter_agg(df: DataFrame, keys: list[str], ts: ColumnLike, val: ColumnLike, limits: Column | None = None, slice=None, name: str = "summary", repeats: bool = False) -> DataFrame:
    """One counter summary for each group; slice: an interval by which long series are cut; repeats: rows of equal times
    all count, in the order of their values, where else the smallest value stands for them."""
    return _metric(df, keys, ts, val, True, limits, slice, name, repeats)


@own_keys
def gauge_agg(df: DataFrame, keys: list[str], ts: ColumnLike, val: ColumnLike, limits: Column | None = None, slice=None, name: str = "summary", repeats: bool = False) -> DataFrame:
    return _metric(df, keys, ts, val, False, limits, slice, name, repeats)


@own_keys
def time_weight(df: DataFrame, keys: list[str], method: str, ts: ColumnLike, val: ColumnLike, slice=None, name: str = "summary") -> DataFrame:
    rows, parts, _ = _points(df, keys, ts, val, slice)
    m = F.lit(timeweight.method_name(method))
    area = timeweight.area(metrics.point(F.col("pt"), F.col("pv")), metrics.point(F.col("t"), F.col("v")), m)
    head, tail = F.col("pt").isNull(), F.col("nt").isNull()
    got = _by(rows, parts).agg(
        F.count("*").alias("n"), _only(head, "t").alias("t1"), _only(head, "v").alias("v1"), _only(tail, "t").alias("t2"), _only(tail, "v").alias("v2"), F.coalesce(F.sum(area), F.lit(0.0)).alias("w")
    ).where("n > 0")
    s = timeweight.build(metrics.point(F.col("t1"), F.col("v1")), metrics.point(F.col("t2"), F.col("v2")), F.col("w"), m)
    out = got.select(*parts, s.alias(name))
    return out if slice is None else _by(out, keys).agg(timeweight.rollup(name).alias(name))


# ---------------------------------------------------------------- states
@own_keys
def state_timeline(df: DataFrame, keys: list[str], ts: ColumnLike, state: ColumnLike) -> DataFrame:
    """Rows (keys, state, start_us, end_us): runs of equal states, the last one ending at the group's last record."""
    rows = df.select(*keys, micros(ts).alias("t"), col(state).alias("state")).where("t is not null and state is not null")
    w = Window.partitionBy(*_partition(keys)).orderBy("t", "state")
    rows = rows.withColumns({"pt": F.lag("t").over(w), "ps": F.lag("state").over(w), "nt": F.lead("t").over(w)})
    clash = (F.col("pt") == F.col("t")) & (F.col("ps") != F.col("state"))
    new = F.when(clash, F.raise_error(F.lit("one time has two states")).cast("boolean")).otherwise(F.col("ps").isNull() | (F.col("ps") != F.col("state")))
    # a group's last record stays beside the starts of runs, to end the last run
    ends = rows.where(new | F.col("nt").isNull()).withColumn("starts", F.col("ps").isNull() | (F.col("ps") != F.col("state")))
    ended = ends.withColumn("end", F.lead("t").over(Window.partitionBy(*_partition(keys)).orderBy("t", "state")))
    return ended.where("starts").select(*keys, "state", F.col("t").alias("start_us"), F.coalesce("end", "t").alias("end_us"))


@own_keys
def state_agg(df: DataFrame, keys: list[str], ts: ColumnLike, state: ColumnLike, slice=None, name: str = "summary") -> DataFrame:
    """One state summary for each group: its runs, which are far fewer than its records, are collected. slice: an
    interval by which long series are cut, each part being summarised apart."""
    if slice is not None:
        cut = df.withColumn("__slice", F.floor(micros(ts) / micros_of(slice)))
        return _by(state_agg(cut, [*keys, "__slice"], ts, state, name="__part"), keys).agg(st.rollup("__part").alias(name))
    runs = state_timeline(df, keys, ts, state)
    listed = _by(runs, keys).agg(F.array_sort(F.collect_list(F.struct("start_us", "end_us", "state"))).alias("r"), F.max("end_us").alias("last_ts"), F.min("start_us").alias("first_ts"))
    timeline = F.transform("r", lambda x: F.struct(x["state"].alias("state"), x["start_us"].alias("start"), x["end_us"].alias("end")))
    return listed.where(F.size("r") > 0).select(*keys, F.struct(timeline.alias("timeline"), "first_ts", "last_ts").alias(name))


@own_keys
def state_durations(df: DataFrame, keys: list[str], ts: ColumnLike, state: ColumnLike) -> DataFrame:
    """Rows (keys, state, duration in microseconds)."""
    runs = state_timeline(df, keys, ts, state)
    return runs.groupBy(*keys, "state").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("duration"))


# ---------------------------------------------------------------- heartbeats
@own_keys
def heartbeat_ranges(df: DataFrame, keys: list[str], heartbeat: ColumnLike, agg_start: ColumnLike, agg_duration, liveness) -> DataFrame:
    """Rows (keys, span_start, span_end, lo, hi, last_seen) in microseconds: live ranges. Keys tell the spans apart."""
    live = micros_of(liveness)
    start = micros(agg_start)
    rows = df.select(*keys, micros(heartbeat).alias("t"), start.alias("span_start"), (start + interval_after(start, agg_duration)).alias("span_end")).where("t is not null")
    bad = (F.col("t") < F.col("span_start")) | (F.col("t") >= F.col("span_end"))
    rows = rows.withColumn("t", F.when(bad, F.raise_error(F.lit("a heartbeat lies outside the span")).cast("long")).otherwise(F.col("t")))
    w = Window.partitionBy(*_partition(keys)).orderBy("t")
    rows = rows.withColumn("new", F.coalesce((F.col("t") > F.lag("t").over(w) + live).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = rows.groupBy(*keys, "island").agg(F.min("span_start").alias("span_start"), F.min("span_end").alias("span_end"), F.min("t").alias("lo"), F.max("t").alias("last_seen"))
    return out.select(*keys, "span_start", "span_end", "lo", F.least(F.col("last_seen") + live, F.col("span_end")).alias("hi"), "last_seen")


@own_keys
def heartbeat_agg(df: DataFrame, keys: list[str], heartbeat: ColumnLike, agg_start: ColumnLike, agg_duration, liveness, slice=None, name: str = "summary") -> DataFrame:
    """One heartbeat summary for each group; slice: an interval by which the heartbeats of busy groups are cut."""
    if slice is not None:
        cut = df.withColumn("__slice", F.floor(micros(heartbeat) / micros_of(slice)))
        parts = heartbeat_agg(cut, [*keys, "__slice"], heartbeat, agg_start, agg_duration, liveness, name="__part")
        return _by(parts, keys).agg(hb.rollup("__part").alias(name))
    ranges = heartbeat_ranges(df, keys, heartbeat, agg_start, agg_duration, liveness)
    listed = _by(ranges, keys).agg(F.min("span_start").alias("a"), F.max("span_end").alias("b"), F.max("last_seen").alias("seen"), F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("r"))
    s = F.struct(F.col("a").alias("start"), F.col("b").alias("end"), F.col("seen").alias("last_seen"), F.lit(micros_of(liveness)).cast("long").alias("liveness"), F.col("r").alias("ranges"))
    return listed.where(F.size("r") > 0).select(*keys, s.cast(hb.SCHEMA).alias(name))


# ---------------------------------------------------------------- filling and rolling
@own_keys
def fill_to(df: DataFrame, keys: list[str], ts: ColumnLike, val: ColumnLike, interval, method: str, slice=None, repeats: bool = False) -> DataFrame:
    """Rows (keys, time, value) with points put every interval into longer gaps: locf, linear or nearest. slice: an
    interval by which long series are cut and spread over tasks. repeats: as for counter_agg."""
    us = micros_of(interval)
    m = method.strip().lower()
    if m not in ("locf", "linear", "interpolate", "nearest"):
        raise ValueError(f"unknown method {method!r}")
    rows, parts, _ = _points(df, keys, ts, val, slice, repeats)
    rows = _linked(rows, keys, parts)
    gap = F.col("nt") - F.col("t")
    steps = F.when(gap > us, F.floor((gap - 1) / us)).otherwise(0)
    rows = rows.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce(steps, F.lit(0)).cast("long")), lambda k: F.col("t") + k * us)))
    off = F.col("at") - F.col("t")
    if m == "locf":
        value = F.col("v")
    elif m == "nearest":
        value = F.when((off == 0) | (off <= F.col("nt") - F.col("at")), F.col("v")).otherwise(F.col("nv"))
    else:
        value = F.when(off == 0, F.col("v")).otherwise(F.col("v") + (F.col("nv") - F.col("v")) * off / gap)
    return rows.select(*keys, F.timestamp_micros("at").alias("time"), value.alias("value"))


@own_keys
def delta(df: DataFrame, keys: list[str], ts: ColumnLike, val: ColumnLike, slice=None, repeats: bool = False) -> DataFrame:
    """Rows (keys, time, value): differences of neighbours. repeats: as for counter_agg."""
    rows, parts, _ = _points(df, keys, ts, val, slice, repeats)
    rows = _linked(rows, keys, parts)
    return rows.where("pt is not null").select(*keys, F.timestamp_micros("t").alias("time"), (F.col("v") - F.col("pv")).alias("value"))


def range_window(keys: list[str], ts: ColumnLike, width) -> Window:
    """The rows of a group in the interval of `width` up to each row."""
    return Window.partitionBy(*_partition(keys)).orderBy(micros(ts)).rangeBetween(-micros_of(width), 0)


__all__ = ["counter_agg", "gauge_agg", "time_weight", "state_timeline", "state_agg", "state_durations", "heartbeat_ranges", "heartbeat_agg", "fill_to", "delta", "range_window"]
