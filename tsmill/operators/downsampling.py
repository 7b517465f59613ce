"""Fewer points that look alike: largest triangles (lttb), with gaps kept (gp_lttb), and smoothing (asap).

Each series is worked on as sorted arrays by an Arrow UDF, many series of a batch together; series are independent.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsmill.functions.base import ColumnLike, col, need, own_keys
from tsmill.functions.metrics import points_of
from tsmill.functions.times import flat_micros, micros

VECTOR = "array<struct<ts: long, val: double>>"


def largest_triangles(ts: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
    """Places of n points: the ends, and of each bucket the point with the largest triangle between the point chosen
    before and the mean of the next bucket. Mean times are whole microseconds."""
    size = len(ts)
    if n >= size or n == 0:
        return np.arange(size)
    every = (size - 2) / (n - 2) if n > 2 else 0.0
    edge = (np.arange(n) * every).astype(np.int64) + 1
    chosen = [0]
    for i in range(n - 2):
        lo, hi = edge[i], edge[i + 1]
        end = min(int(edge[i + 2]) if i + 2 < len(edge) else size, size)
        after = slice(hi, end)
        # division of the sum towards 0, as whole numbers
        total, count = int(ts[after].sum()), end - hi
        mean_t = -(-total // count) if total < 0 else total // count
        mean_v = val[after].sum() / count
        a = chosen[-1]
        area = np.abs(float(ts[a] - mean_t) * (val[lo:hi] - val[a]) - (ts[a] - ts[lo:hi]).astype(float) * (mean_v - val[a])) * 0.5
        area = np.where(np.isnan(area), -1.0, area)
        chosen.append(int(lo + (area.argmax() if area.max(initial=-1.0) > -1.0 else 0)))
    return np.array([*chosen, size - 1])


def with_gaps(ts: np.ndarray, val: np.ndarray, n: int, gap: int) -> np.ndarray:
    """Places of about n points: each run between gaps longer than `gap` keeps its ends and gets points by its length."""
    size = len(ts)
    gap = gap if gap > 0 else int((ts[-1] - ts[0]) // n)
    cuts = np.flatnonzero(np.diff(ts) > gap) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [size]])
    # ends that are still owed: one for a lone point, two for a run; the last run always counts two
    owed = 2 + sum(1 if e - s == 1 else 2 for s, e in zip(starts[:-1], ends[:-1]))
    left, out = n, []
    for s, e in zip(starts[:-1].tolist(), ends[:-1].tolist()):
        if e - s == 1:
            out.append(np.array([s]))
            left, owed = left - 1, owed - 1
            continue
        inner = (e - 2 - s) / (size - s - owed) if size - s != owed else 0.0
        mine = max(int((left - owed) * inner), 0) + 2
        out.append(s + largest_triangles(ts[s:e], val[s:e], mine))
        left, owed = left - mine, owed - 2
    s = int(starts[-1])
    out.append(np.array([s]) if s == size - 1 else s + largest_triangles(ts[s:], val[s:], max(left, 2)))
    return np.concatenate(out)


def _means(x: np.ndarray, width: int, step: int) -> np.ndarray:
    """Moving means over whole windows of `width`."""
    if width >= len(x) + 1:
        return x[:0]
    total = np.concatenate([[0.0], np.cumsum(x)])
    return ((total[width:] - total[:-width]) / width)[::step]


def _roughness(x: np.ndarray) -> float:
    return float(np.diff(x).std()) if len(x) > 1 else 0.0


def _tails(x: np.ndarray) -> float:
    d = x - x.mean()
    spread = (d * d).mean()
    return float((d**4).mean() / (spread * spread)) if spread else float("nan")


def smooth(val: np.ndarray, resolution: int) -> tuple[np.ndarray, int, int]:
    """Smoothed values, the width of the means taken beforehand, and the width of the moving mean: the widest search
    window at which tails are no lighter than before and roughness is least."""
    if resolution <= 0 or not len(val):
        return val[:0], 0, 0
    before = int(len(val) / resolution) if len(val) > 2 * resolution else 1
    x = _means(val, before, before) if before > 1 else val
    if len(x) <= 1:
        return x, before, 1
    least, tails, width = _roughness(x), _tails(x), 1
    lo, hi = 1, len(x) // 10
    while lo <= hi:
        w = (lo + hi + 1) // 2
        y = _means(x, w, 1)
        if _tails(y) >= tails:
            if _roughness(y) < least:
                width, least = w, _roughness(y)
            lo = w + 1
        else:
            hi = w - 1
    return _means(x, width, 1), before, width


def _each(vectors: pa.ListArray, f) -> pa.ListArray:
    """f of the arrays of each vector; points are never Python objects."""
    edge, points = vectors.offsets.to_numpy(), vectors.values
    ts, val = points.field("ts").to_numpy(zero_copy_only=False), points.field("val").to_numpy(zero_copy_only=False).astype(float, copy=False)
    missing = vectors.is_null().to_numpy(zero_copy_only=False)
    times, values, sizes = [np.zeros(0, np.int64)], [np.zeros(0)], [0]
    for s, e, none in zip(edge[:-1].tolist(), edge[1:].tolist(), missing.tolist()):
        t, x = (ts[:0], val[:0]) if none else f(ts[s:e], val[s:e])
        times.append(t)
        values.append(x)
        sizes.append(len(t))
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate(times), pa.int64()), pa.array(np.concatenate(values), pa.float64())], ["ts", "val"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat, mask=pa.array(missing))


@lru_cache(256)
def _udf(kind: str, n: int, gap: int = 0):
    def chosen(ts, val):
        at = largest_triangles(ts, val, n) if kind == "lttb" else with_gaps(ts, val, n, gap) if len(ts) else np.zeros(0, np.int64)
        return ts[at], val[at]

    def smoothed(ts, val):
        y, before, width = smooth(val, n)
        at = np.minimum((np.arange(len(y)) + width // 2) * before, max(0, len(ts) - 1))
        return ts[at] if len(y) else ts[:0], y

    f = smoothed if kind == "asap" else chosen

    @F.arrow_udf(VECTOR)
    def apply(v: pa.Array) -> pa.Array:
        return _each(v, f)

    return apply


def lttb_column(vector: ColumnLike, n: int) -> Column:
    need(n > 2, "lttb needs a resolution over 2")
    return _udf("lttb", n)(col(vector))


def asap_column(vector: ColumnLike, resolution: int) -> Column:
    return _udf("asap", resolution)(col(vector))


def gp_lttb_column(vector: ColumnLike, n: int, gap=None) -> Column:
    need(n > 2, "gp_lttb needs a resolution over 2")
    return _udf("gp", n, flat_micros(gap) if gap is not None else 0)(col(vector))


def _series(df: DataFrame, keys: list[str], ts: str, val: str) -> DataFrame:
    grouped = df.groupBy(*keys) if keys else df
    return grouped.agg(points_of(ts, val).alias("points")).where(F.size("points") > 0)


def lttb(df: DataFrame, keys: list[str], ts: str, val: str, n: int) -> DataFrame:
    """keys, points: n points of each series. A series must fit into a task; series are spread over tasks."""
    return _series(df, keys, ts, val).select(*keys, lttb_column("points", n).alias("points"))


def gp_lttb(df: DataFrame, keys: list[str], ts: str, val: str, n: int, gap=None) -> DataFrame:
    return _series(df, keys, ts, val).select(*keys, gp_lttb_column("points", n, gap).alias("points"))


@own_keys
def asap_smooth(df: DataFrame, keys: list[str], ts: str, val: str, resolution: int) -> DataFrame:
    """keys, points: each series smoothed. The means taken beforehand are Spark's, over a window that spills, so that no
    more than two points for each of the resolution's are collected and reach Python, however long a series is."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__t", "__v")
    rows = df.select(*keys, micros(ts).alias("__t"), col(val).cast("double").alias("__v")).where("__t is not null and __v is not null")
    n = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({"__i": F.row_number().over(w).cast("long") - 1, "__n": n})
    before = F.when(F.col("__n") > 2 * resolution, F.floor(F.col("__n") / resolution)).otherwise(1) if resolution > 0 else F.lit(1)
    rows = rows.withColumn("__before", before.cast("long")).withColumn("__bucket", F.floor(F.col("__i") / F.col("__before")))
    means = rows.groupBy(*keys, "__before", "__bucket").agg(F.count("*").alias("__n"), F.min("__t").alias("ts"), (F.sum("__v") / F.col("__before")).alias("val"))
    whole = F.when(F.col("__n") == F.col("__before"), F.struct("__bucket", "ts", "val"))  # the last bucket may not be
    grouped = means.groupBy(*keys) if keys else means.groupBy()
    vector = grouped.agg(F.sort_array(F.collect_list(whole)).alias("points")).where(F.size("points") > 0)
    points = F.transform("points", lambda p: F.struct(p["ts"].alias("ts"), p["val"].alias("val")))
    return vector.select(*keys, asap_column(points, resolution).alias("points"))
