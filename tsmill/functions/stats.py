"""Statistical summaries of one and two variables.

A summary holds n, sums and centred power sums. It is built from Spark's own aggregates in one pass with partial
aggregation; summaries are merged in closed form around their common mean.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsmill.functions.base import NAN, Accessors, ColumnLike, col, ieee_div, let, need, sum_of

EXACT = 1 << 53


def _moments(x: Column, v: str) -> list[Column]:
    n = F.count(x).cast("double")
    spread = F.coalesce(F.var_pop(x), F.lit(0.0))
    m2 = spread * n
    # Spark gives no skewness or kurtosis where nothing varies; the third and fourth sums are 0 there
    m3 = F.coalesce(F.skewness(x), F.lit(0.0)) * F.pow(spread, F.lit(1.5)) * n
    m4 = F.coalesce((F.kurtosis(x) + 3.0) * spread * spread * n, F.lit(0.0))
    s = F.coalesce(F.sum(x), F.lit(0.0))
    # NaN is the largest double: only finite inputs whose sums are not finite are an error
    large = F.max(F.abs(x)) < float("inf")
    over = large & ~((F.abs(s) < float("inf")) & (m2 < float("inf")) & (F.abs(m3) < float("inf")) & (m4 < float("inf")))
    s = F.when(over, F.raise_error(F.lit("[22003] value out of range: overflow")).cast("double")).otherwise(s)
    return [s.alias(f"s{v}"), m2.alias(f"s{v}2"), m3.alias(f"s{v}3"), m4.alias(f"s{v}4")]


def stats_agg(y: ColumnLike, x: ColumnLike | None = None) -> Column:
    """Summary of one variable, or of y against x (y comes first). Rows with a null are left out; none left: n = 0.

    Finite values whose power sums are beyond a double are an error.
    """
    if x is None:
        v = col(y).cast("double")
        return F.struct(F.count(v).alias("n"), *_moments(v, "x"))
    a, b = col(y).cast("double"), col(x).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    n = F.count(a)
    cross = F.coalesce(F.covar_pop(a, b), F.lit(0.0)) * n
    return F.struct(n.alias("n"), *_moments(b, "x"), *_moments(a, "y"), cross.alias("sxy"))


def stats_agg_int(x: ColumnLike) -> Column:
    """stats_agg of integers, with an error for those a double cannot hold."""
    v = col(x).cast("long")
    return stats_agg(F.when(F.abs(v) > EXACT, F.raise_error(F.lit("integer too large for stats_agg"))).otherwise(v.cast("double")))


#: Variants that differ elsewhere in how windows slide; one implementation serves them here.
stats_agg_no_inv = stats_agg
stats_agg_tf = stats_agg


def merge(rows: Column, two: bool) -> Column:
    """One summary of an array of summaries."""
    held = F.filter(rows, lambda s: s.isNotNull() & (s["n"] > 0))
    variables = ("x", "y") if two else ("x",)

    def sums(held: Column) -> Column:
        n = F.aggregate(held, F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
        return F.struct(held.alias("held"), n.alias("n"), *(sum_of(held, lambda s, v=v: s[f"s{v}"]).alias(f"s{v}") for v in variables))

    def means(t: Column) -> Column:
        return F.struct(t.alias("t"), *((t[f"s{v}"] / F.when(t["n"] > 0, t["n"])).alias(f"m{v}") for v in variables))

    def powers(r: Column) -> Column:
        held, out = r["t"]["held"], [r["t"]["n"].alias("n")]
        off = {v: (lambda s, v=v: s[f"s{v}"] / s["n"] - r[f"m{v}"]) for v in variables}
        for v in variables:
            d = off[v]
            m2 = sum_of(held, lambda s, v=v, d=d: s[f"s{v}2"] + s["n"] * d(s) * d(s))
            m3 = sum_of(held, lambda s, v=v, d=d: s[f"s{v}3"] + 3 * d(s) * s[f"s{v}2"] + s["n"] * d(s) * d(s) * d(s))
            m4 = sum_of(held, lambda s, v=v, d=d: s[f"s{v}4"] + 4 * d(s) * s[f"s{v}3"] + 6 * d(s) * d(s) * s[f"s{v}2"] + s["n"] * d(s) * d(s) * d(s) * d(s))
            out += [r["t"][f"s{v}"].alias(f"s{v}"), m2.alias(f"s{v}2"), m3.alias(f"s{v}3"), m4.alias(f"s{v}4")]
        if two:
            out.append(sum_of(held, lambda s: s["sxy"] + s["n"] * off["x"](s) * off["y"](s)).alias("sxy"))
        return F.struct(*out)

    # the sums are bound before the moments around their means are taken, so that the work is linear
    return let(let(let(held, sums), means), powers)


def rollup(summary: ColumnLike) -> Column:
    """Merge summaries of one variable. With .over(window), see rolling()."""
    return merge(F.collect_list(col(summary)), False)


def rollup_2d(summary: ColumnLike) -> Column:
    return merge(F.collect_list(col(summary)), True)


def rolling(summary: ColumnLike, window) -> Column:
    """rollup over a window of rows."""
    return merge(F.collect_list(col(summary)).over(window), False)


def rolling_2d(summary: ColumnLike, window) -> Column:
    return merge(F.collect_list(col(summary)).over(window), True)


# ---------------------------------------------------------------- accessors
def _sample(method: str) -> bool:
    m = method.strip().lower()
    need(m in ("population", "pop", "sample", "samp"), f"unknown method {method!r}: population or sample")
    return m.startswith("samp")


def num_vals(s: ColumnLike) -> Column:
    return col(s)["n"]


def _any(s: Column, x: Column) -> Column:
    return F.when(s["n"] > 0, x)


def _average(s, v):
    s = col(s)
    return s[f"s{v}"] / F.when(s["n"] > 0, s["n"])


def _sum(s, v):
    s = col(s)
    return _any(s, s[f"s{v}"])


def _variance(s, method, v, two):
    s = col(s)
    if not _sample(method):
        return s[f"s{v}2"] / F.when(s["n"] > 0, s["n"])
    if two:
        return s[f"s{v}2"] / F.when(s["n"] > 1, s["n"] - 1)
    return F.when(s["n"] == 1, F.lit(NAN)).otherwise(s[f"s{v}2"] / F.when(s["n"] > 1, s["n"] - 1))


def _scaled(s, method, v, two, moment):
    """The moment over n, or n - 1, in units of the standard deviation by the same method."""
    s = col(s)
    sd = F.sqrt(_variance(s, method, v, two))
    n = s["n"] - 1 if _sample(method) else s["n"]
    return _any(s, ieee_div(ieee_div(s[f"s{v}{moment}"], n), F.pow(sd, F.lit(float(moment)))))


def average(s: ColumnLike) -> Column:
    return _average(s, "x")


def average_x(s: ColumnLike) -> Column:
    return _average(s, "x")


def average_y(s: ColumnLike) -> Column:
    return _average(s, "y")


def sum(s: ColumnLike) -> Column:  # noqa: A001
    return _sum(s, "x")


def sum_x(s: ColumnLike) -> Column:
    return _sum(s, "x")


def sum_y(s: ColumnLike) -> Column:
    return _sum(s, "y")


def variance(s: ColumnLike, method: str = "sample") -> Column:
    return _variance(s, method, "x", False)


def variance_x(s: ColumnLike, method: str = "sample") -> Column:
    return _variance(s, method, "x", True)


def variance_y(s: ColumnLike, method: str = "sample") -> Column:
    return _variance(s, method, "y", True)


def stddev(s: ColumnLike, method: str = "sample") -> Column:
    return F.sqrt(variance(s, method))


def stddev_x(s: ColumnLike, method: str = "sample") -> Column:
    return F.sqrt(variance_x(s, method))


def stddev_y(s: ColumnLike, method: str = "sample") -> Column:
    return F.sqrt(variance_y(s, method))


def skewness(s: ColumnLike, method: str = "sample") -> Column:
    return _scaled(s, method, "x", False, 3)


def skewness_x(s: ColumnLike, method: str = "sample") -> Column:
    return _scaled(s, method, "x", True, 3)


def skewness_y(s: ColumnLike, method: str = "sample") -> Column:
    return _scaled(s, method, "y", True, 3)


def kurtosis(s: ColumnLike, method: str = "sample") -> Column:
    """The fourth standardised moment, not the excess over 3."""
    return _scaled(s, method, "x", False, 4)


def kurtosis_x(s: ColumnLike, method: str = "sample") -> Column:
    return _scaled(s, method, "x", True, 4)


def kurtosis_y(s: ColumnLike, method: str = "sample") -> Column:
    return _scaled(s, method, "y", True, 4)


def slope(s: ColumnLike) -> Column:
    s = col(s)
    return s["sxy"] / F.when((s["n"] > 1) & (s["sx2"] != 0), s["sx2"])


def intercept(s: ColumnLike) -> Column:
    s = col(s)
    return (s["sy"] - s["sx"] * s["sxy"] / F.when(s["sx2"] != 0, s["sx2"])) / F.when(s["n"] > 1, s["n"])


def x_intercept(s: ColumnLike) -> Column:
    """Where the fitted line meets 0; of a vertical line its x, of a horizontal one null."""
    s = col(s)
    mean_x, mean_y = s["sx"] / F.when(s["n"] > 0, s["n"]), s["sy"] / F.when(s["n"] > 0, s["n"])
    crossing = mean_x - mean_y * s["sx2"] / F.when(s["sxy"] != 0, s["sxy"])
    return F.when((s["n"] > 1) & (s["sx2"] == 0), mean_x).when(s["n"] > 1, crossing)


def corr(s: ColumnLike) -> Column:
    s = col(s)
    product = s["sx2"] * s["sy2"]
    return s["sxy"] / F.when((s["n"] > 0) & (product != 0), F.sqrt(s["sx2"]) * F.sqrt(s["sy2"]))


def determination_coeff(s: ColumnLike) -> Column:
    """The square of corr; 1 for a horizontal line, null for a vertical one."""
    s = col(s)
    return F.when((s["n"] > 0) & (s["sx2"] != 0), F.when(s["sy2"] == 0, F.lit(1.0)).otherwise(s["sxy"] * s["sxy"] / (s["sx2"] * F.when(s["sy2"] != 0, s["sy2"]))))


def covariance(s: ColumnLike, method: str = "sample") -> Column:
    s = col(s)
    return s["sxy"] / (F.when(s["n"] > 1, s["n"] - 1) if _sample(method) else F.when(s["n"] > 0, s["n"]))


acc = Accessors(
    num_vals, average, average_x, average_y, sum, sum_x, sum_y, variance, variance_x, variance_y, stddev, stddev_x, stddev_y, skewness, skewness_x, skewness_y,
    kurtosis, kurtosis_x, kurtosis_y, slope, intercept, x_intercept, corr, determination_coeff, covariance,
)
