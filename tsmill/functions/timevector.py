"""Time vectors: arrays of (time, value) points, and pipelines of elements over them.

A time vector is an array<struct<ts: long (microseconds), val: double>>, sorted by time when it comes from timevector() or
rollup(). A pipeline is a list of elements joined by >>; applied to a column it becomes one nested expression, so that
Catalyst sees plain functions. Elements that need sorted or null-free points fail on others.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsmill.functions import metrics, stats
from tsmill.functions.base import INF, NAN, ColumnLike, col, ieee_div, let, need, let2
from tsmill.functions.metrics import POINT, points_of
from tsmill.functions.state import _prev
from tsmill.functions.times import flat_micros, micros

VECTOR = f"array<{POINT}>"


def timevector(ts: ColumnLike, val: ColumnLike) -> Column:
    """The points of a group in order of time; a null value stays, a null time does not."""
    us = micros(ts)
    return F.sort_array(F.collect_list(F.when(us.isNotNull(), F.struct(us.alias("ts"), col(val).cast("double").alias("val"))))).cast(VECTOR)


def rollup(vector: ColumnLike) -> Column:
    return F.sort_array(F.flatten(F.collect_list(col(vector)))).cast(VECTOR)


def unnest(vector: ColumnLike) -> Column:
    """Rows (time, value)."""
    return F.inline(F.transform(col(vector), lambda p: F.struct(F.timestamp_micros(p["ts"]).alias("time"), p["val"].alias("value"))))


def to_plotly(vector: ColumnLike) -> Column:
    """JSON text with lists of times and values; an error for values that JSON cannot hold."""
    v = col(vector)
    bad = F.exists(v, lambda p: F.isnan(p["val"]) | (F.abs(p["val"]) == INF))
    out = F.to_json(F.struct(F.transform(v, lambda p: _time_text(p)).alias("times"), F.transform(v, lambda p: p["val"]).alias("vals")), {"ignoreNullFields": "false"})
    return F.when(bad, F.raise_error(F.lit("values must be finite"))).otherwise(out)


def _time_text(p: Column) -> Column:
    return F.date_format(F.timestamp_micros(p["ts"]), "yyyy-MM-dd HH:mm:ss.SSSSSSxxx")


def to_text(vector: ColumnLike, template: str) -> Column:
    """template with {{TIMES}}, {{VALUES}} and {{TIMEVALS}} replaced by JSON lists; the last of pairs."""
    v = col(vector)
    times = F.to_json(F.transform(v, _time_text))
    vals = F.to_json(F.transform(v, lambda p: p["val"]))
    pairs = F.concat(F.lit("["), F.array_join(F.transform(v, lambda p: F.concat(F.lit('["'), _time_text(p), F.lit('", '), F.coalesce(p["val"].cast("string"), F.lit("null")), F.lit("]"))), ", "), F.lit("]"))
    out = F.lit(template)
    for name, text in (("TIMES", times), ("VALUES", vals), ("TIMEVALS", pairs)):
        out = F.regexp_replace(out, F.lit(r"\{\{\s*" + name + r"(\s*\|[^}]*)?\s*\}\}"), F.regexp_replace(text, F.lit(r"([\\$])"), F.lit(r"\\$1")))
    return out


def asof(left: ColumnLike, right: ColumnLike) -> Column:
    """array<struct<value1, value2, time>>: for each point of right the last value of left at or before it.

    Each point of right is looked up in the sorted left vector by bisection. operators.asof joins tables of any size.
    """
    of = lambda v: F.array_sort(F.transform(v, lambda p: F.struct(p["ts"].alias("ts"), p["val"].alias("val"))))

    def before(a: Column, at: Column) -> Column:
        """How many points of a are not later than `at`, one binary digit after the other."""
        digits = F.array(*(F.lit(1 << b) for b in range(30, -1, -1)))
        late = lambda n: F.get(a, n - 1)["ts"] > at
        return F.aggregate(digits, F.lit(0), lambda n, d: F.when((F.size(a) - n >= d) & ~F.coalesce(late(n + d), F.lit(False)), n + d).otherwise(n))

    def find(a: Column, b: Column) -> Column:
        return F.transform(b, lambda p: F.struct(F.get(a, before(a, p["ts"]) - 1)["val"].alias("value1"), p["val"].alias("value2"), F.timestamp_micros(p["ts"]).alias("time")))

    rows = let2(of(col(left)), of(col(right)), find)
    empty = (F.size(col(left)) == 0) | (F.size(col(right)) == 0)
    return F.when(empty, F.transform(F.array(F.raise_error(F.lit("both time vectors need points"))), lambda _: F.get(rows, F.lit(0)))).otherwise(rows)


# ---------------------------------------------------------------- pipelines
class Pipeline:
    """Elements to be applied one after the other: `vector >> a >> b`, or `vector >> (a >> b)`."""

    def __init__(self, *steps: Callable[[Column], Column]):
        self.steps = steps

    def __rshift__(self, other: Pipeline) -> Pipeline:
        return Pipeline(*self.steps, *other.steps)

    def __call__(self, vector: ColumnLike) -> Column:
        out = col(vector)
        for s in self.steps:
            out = let(out, s)
        return out

    def __rrshift__(self, vector: ColumnLike) -> Column:
        return self(vector)


def _checked(v: Column, sorted_: bool = True, full: bool = True) -> Column:
    """v, or an error if its points are out of order or null."""
    wrong = F.lit(False)
    if sorted_:
        wrong = wrong | F.exists(F.zip_with(v, _prev(v), lambda a, b: F.coalesce(a["ts"] < b["ts"], F.lit(False))), lambda x: x)
    if full:
        wrong = wrong | F.exists(v, lambda p: p["val"].isNull())
    return F.when(wrong, F.raise_error(F.lit("the time vector must be sorted and free of nulls")).cast("boolean")).otherwise(F.lit(True))


def _if_sound(v: Column, out: Column, sorted_: bool = True, full: bool = True) -> Column:
    return F.when(_checked(v, sorted_, full), out)


def _pt(ts: Column, val: Column) -> Column:
    return F.struct(ts.alias("ts"), val.alias("val"))


def sort() -> Pipeline:
    return Pipeline(lambda v: F.array_sort(v, lambda a, b: F.when(a["ts"] < b["ts"], -1).when(a["ts"] > b["ts"], 1).otherwise(0)))


def delta() -> Pipeline:
    """Differences of neighbours: a point fewer."""
    return Pipeline(lambda v: _if_sound(v, F.slice(F.zip_with(v, _prev(v), lambda a, b: _pt(a["ts"], a["val"] - b["val"])), 2, F.greatest(F.size(v) - 1, F.lit(0)))))


def filter(f) -> Pipeline:  # noqa: A001
    """Points for which a lambda text, or a function of (time, value), holds."""
    g = _function(f)
    return Pipeline(lambda v: F.filter(v, lambda p: g(p["ts"], p["val"])))


def map(f) -> Pipeline:  # noqa: A001
    """Points changed by a lambda text that gives a value or (time, value), or by a function of (time, value)."""
    from tsmill.functions import expressions

    if isinstance(f, str):
        return Pipeline(lambda v: F.transform(v, lambda p: expressions.point(f, p["ts"], p["val"])))

    def step(p: Column) -> Column:
        out = f(p["ts"], p["val"])
        return _pt(*out) if isinstance(out, tuple) else _pt(p["ts"], out)

    return Pipeline(lambda v: F.transform(v, step))


def _function(f):
    from tsmill.functions import expressions

    return (lambda t, x: expressions.compile(f, t, x)[1]) if isinstance(f, str) else f


def map_data(f: Callable[[Column], Column]) -> Pipeline:
    """Values changed by a function of a column, such as one of pyspark.sql.functions; nulls stay."""
    return Pipeline(lambda v: F.transform(v, lambda p: _pt(p["ts"], F.when(p["val"].isNotNull(), f(p["val"]).cast("double")))))


def map_series(f: Callable[[Column], Column]) -> Pipeline:
    """The whole vector changed by a function of its column, or by a UDF from vector to vector."""
    return Pipeline(lambda v: f(v))


def fill_to(interval, method: str) -> Pipeline:
    """Points put every interval into gaps longer than it: locf, linear (interpolate) or nearest (a tie goes left)."""
    m = method.strip().lower()
    need(m in ("locf", "linear", "interpolate", "nearest"), f"unknown method {method!r}")
    us = flat_micros(interval)
    need(us > 0, "the interval must be positive")

    def between(a: Column, b: Column) -> Column:
        gap = b["ts"] - a["ts"]
        at = F.transform(F.sequence(F.lit(1), F.floor((gap - 1) / us)), lambda k: a["ts"] + k * us)
        if m == "locf":
            val = lambda t: a["val"]
        elif m == "nearest":
            val = lambda t: F.when(t - a["ts"] <= b["ts"] - t, a["val"]).otherwise(b["val"])
        else:
            val = lambda t: a["val"] + (b["val"] - a["val"]) * (t - a["ts"]) / gap
        return F.when(gap > us, F.transform(at, lambda t: _pt(t, val(t)))).otherwise(F.array().cast(VECTOR))

    def step(v: Column) -> Column:
        following = F.concat(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(F.array(F.lit(None).cast(POINT)), 1, F.least(F.size(v), F.lit(1))))
        pieces = F.zip_with(v, following, lambda a, b: F.when(b.isNull(), F.array(a).cast(VECTOR)).otherwise(F.concat(F.array(a).cast(VECTOR), between(a, b))))
        return _if_sound(v, F.flatten(pieces))

    return Pipeline(step)


def _values(f: Callable[[Column], Column]) -> Pipeline:
    return Pipeline(lambda v: F.transform(v, lambda p: _pt(p["ts"], f(p["val"]).cast("double"))))


def add(x: float) -> Pipeline:
    return _values(lambda v: v + float(x))


def sub(x: float) -> Pipeline:
    return _values(lambda v: v - float(x))


def mul(x: float) -> Pipeline:
    return _values(lambda v: v * float(x))


def div(x: float) -> Pipeline:
    return _values(lambda v: ieee_div(v, F.lit(float(x))))


def mod(x: float) -> Pipeline:
    """Remainder with the sign of the value; by 0 it is NaN."""
    return _values(lambda v: v % float(x) if x else F.when(v.isNotNull(), F.lit(NAN)))


def power(x: float) -> Pipeline:
    return _values(lambda v: F.pow(v, F.lit(float(x))))


def ieee_ln(v: Column) -> Column:
    return F.when(v == 0, F.lit(-INF)).when(v < 0, F.lit(NAN)).otherwise(F.ln(F.when(v > 0, v)))


def logn(base: float) -> Pipeline:
    return _values(lambda v: ieee_div(ieee_ln(v), F.lit(math.log(base))))


def ieee_sign(v: Column) -> Column:
    """1 or -1 by the sign bit: 1 for 0, -1 for -0, NaN for NaN."""
    return F.when(F.isnan(v), v).when((v < 0) | ((v == 0) & F.startswith(v.cast("string"), F.lit("-"))), F.lit(-1.0)).when(v.isNotNull(), F.lit(1.0))


def half_away(v: Column) -> Column:
    """Rounded to a whole number, halves away from 0."""
    down = F.floor(F.abs(v))
    whole = F.abs(v) >= 2.0**52  # whole already, and beyond what floor() holds
    return F.when(whole | F.isnan(v), v).otherwise(F.signum(v) * (down + F.when(F.abs(v) - down >= 0.5, 1.0).otherwise(0.0)))


def whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """floor() and ceil() as doubles; values beyond 2^52 are whole already."""
    return lambda v: F.when((F.abs(v) >= 2.0**52) | F.isnan(v), v).otherwise(f(F.when(F.abs(v) < 2.0**52, v)).cast("double"))


def truncated(v: Column) -> Column:
    return F.when(v < 0, whole(F.ceil)(v)).otherwise(whole(F.floor)(v))


UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "cbrt": F.cbrt, "ceil": whole(F.ceil), "floor": whole(F.floor), "ln": ieee_ln, "log10": lambda v: ieee_ln(v) / math.log(10), "round": half_away, "sign": ieee_sign,
    "sqrt": F.sqrt, "trunc": truncated,
}
UNARY["log10"] = lambda v: F.when(v == 0, F.lit(-INF)).when(v < 0, F.lit(NAN)).otherwise(F.log10(F.when(v > 0, v)))


def abs() -> Pipeline:  # noqa: A001
    return _values(UNARY["abs"])


def cbrt() -> Pipeline:
    return _values(UNARY["cbrt"])


def ceil() -> Pipeline:
    return _values(UNARY["ceil"])


def floor() -> Pipeline:
    return _values(UNARY["floor"])


def ln() -> Pipeline:
    return _values(UNARY["ln"])


def log10() -> Pipeline:
    return _values(UNARY["log10"])


def round() -> Pipeline:  # noqa: A001
    return _values(UNARY["round"])


def sign() -> Pipeline:
    return _values(UNARY["sign"])


def sqrt() -> Pipeline:
    return _values(UNARY["sqrt"])


def trunc() -> Pipeline:
    return _values(UNARY["trunc"])


# ---------------------------------------------------------------- ends of pipelines
def materialize() -> Pipeline:
    """The vector itself."""
    return Pipeline(lambda v: v)


def num_vals() -> Pipeline:
    return Pipeline(lambda v: F.size(v).cast("long"))


def sum() -> Pipeline:  # noqa: A001
    return Pipeline(lambda v: _if_sound(v, F.aggregate(v, F.lit(0.0), lambda a, p: a + p["val"]), sorted_=False))


def average() -> Pipeline:
    return Pipeline(lambda v: _if_sound(v, F.aggregate(v, F.lit(0.0), lambda a, p: a + p["val"]) / F.when(F.size(v) > 0, F.size(v)), sorted_=False))


def stats_agg() -> Pipeline:
    """A one-variable summary, see functions.stats."""

    def step(v: Column) -> Column:
        one = lambda p: F.struct(F.lit(1).cast("long").alias("n"), p["val"].alias("sx"), F.lit(0.0).alias("sx2"), F.lit(0.0).alias("sx3"), F.lit(0.0).alias("sx4"))
        return _if_sound(v, let(F.transform(v, one), lambda rows: stats.merge(rows, False)), sorted_=False)

    return Pipeline(step)


def counter_agg(repeats: bool = False) -> Pipeline:
    """A counter summary, see functions.metrics; null for no points."""
    return Pipeline(lambda v: _if_sound(v, metrics.from_points(F.array_sort(v), None, True, repeats), sorted_=False))


def gauge_agg(repeats: bool = False) -> Pipeline:
    return Pipeline(lambda v: _if_sound(v, metrics.from_points(F.array_sort(v), None, False, repeats), sorted_=False))


def percentile_agg(size: int = 200, max_error: float = 0.001) -> Pipeline:
    """A percentile sketch, see operators.sketches.uddsketch."""
    from tsmill.operators import sketches

    log_gamma = math.log((1 + max_error) / (1 - max_error))

    def step(v: Column) -> Column:
        def code(x: Column) -> Column:
            sign = F.when(x > 0, 1).when(x < 0, -1).otherwise(0)
            return sketches._code(sign, F.when(x == 0, F.lit(0)).otherwise(F.ceil(F.ln(F.abs(x)) / log_gamma)).cast("long"))

        # sorted, so that each bucket is a run: counted from where it begins to where the next one does
        ks = F.sort_array(F.transform(F.filter(v, lambda p: p["val"].isNotNull()), lambda p: code(p["val"])))
        begins = lambda k: F.filter(F.sequence(F.lit(0), F.size(k) - 1), lambda i: (i == 0) | (F.get(k, i - 1) != F.get(k, i)))

        def runs(k: Column) -> Column:
            """Where runs begin (at), their codes, and the number of values."""
            return let(begins(k), lambda at: F.struct(at.alias("at"), F.transform(at, lambda i: F.get(k, i)).alias("code"), F.size(k).alias("n")))

        def finish(r: Column) -> Column:
            level, at = r["c"], r["r"]["at"]

            def bucket(k: Column, first: Column, i: Column, j: Column) -> Column:
                sign, idx = sketches._sign_idx(F.get(k, i), level)
                n = F.coalesce(F.get(at, F.get(first, j + 1)), r["r"]["n"]) - F.get(at, i)
                return F.struct(sign.alias("sign"), idx.alias("idx"), n.cast("long").alias("n"))

            small = F.transform(r["r"]["code"], lambda x: sketches._compacted_code(x, level))
            buckets = let(small, lambda k: let(begins(k), lambda first: F.transform(first, lambda i, j: bucket(k, first, i, j))))
            total = F.aggregate(r["v"], F.lit(0.0), lambda a, p: a + F.coalesce(p["val"], F.lit(0.0)))
            return F.struct(sketches._alpha(max_error, level).alias("alpha"), F.lit(float(max_error)).alias("error"), F.lit(size).alias("size"), level.cast("int").alias("compactions"), r["r"]["n"].cast("long").alias("count"), total.alias("sum"), buckets.alias("buckets"))

        def levelled(r: Column) -> Column:
            return F.struct(r["r"].alias("r"), r["v"].alias("v"), sketches._code_levels(r["r"]["code"], size).alias("c"))

        def sketch(r: Column) -> Column:
            return F.when(F.size(r["k"]) > 0, let(let(F.struct(runs(r["k"]).alias("r"), r["v"].alias("v")), levelled), finish))

        return let(F.struct(ks.alias("k"), v.alias("v")), sketch)

    return Pipeline(step)


def hyperloglog(size: int) -> Pipeline:
    """A distinct-count sketch of the values, see operators.sketches.hyperloglog."""
    from tsmill.operators import sketches

    p = sketches._precision(size)

    def register(x: Column) -> Column:
        h = F.xxhash64(x)
        rest = h.bitwiseAND(F.lit((1 << (64 - p)) - 1))
        rho = F.when(rest == 0, 64 - p + 1).otherwise(64 - p - F.length(F.bin(rest)) + 1)
        return F.shiftrightunsigned(h, 64 - p).cast("int") * 64 + rho.cast("int")

    def step(v: Column) -> Column:
        # register * 64 + rank as one number, which is hashed; structs would be compared one by one
        rows = F.sort_array(F.array_distinct(F.transform(F.filter(v, lambda q: q["val"].isNotNull()), lambda q: register(q["val"]))))
        # sorted by register and rank: the last of each register is its best
        of = lambda x: F.shiftright(x, 6)
        best = let(rows, lambda a: F.filter(a, lambda x, i: F.coalesce(of(F.get(a, i + 1)) != of(x), F.lit(True))))
        return F.struct(F.lit(p).alias("precision"), F.transform(best, lambda x: F.struct(of(x).alias("i"), x.bitwiseAND(63).alias("r"))).alias("registers"))

    return Pipeline(step)


def of_points(ts: ColumnLike, val: ColumnLike) -> Column:
    """As timevector, rows with null values left out."""
    return points_of(ts, val)


def lttb(n: int) -> Pipeline:
    from tsmill.operators.downsampling import lttb_column

    return Pipeline(lambda v: lttb_column(v, n))


def asap_smooth(n: int) -> Pipeline:
    from tsmill.operators.downsampling import asap_column

    return Pipeline(lambda v: asap_column(v, n))
