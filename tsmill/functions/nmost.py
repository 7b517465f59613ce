"""The n largest or smallest values of a group, alone or with a payload.

A summary is struct<n, vals: array> (by-forms: array<struct<val, data>>), best first. Groups are small once the
window form tsmill.operators.ranking.top_n has cut each one to n rows before it is collected; the aggregates here
collect a group first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsmill.functions.base import Accessors, ColumnLike, col, need


def _cut(vals: Column, n: int, largest: bool) -> Column:
    need(n > 0, "n must be positive")
    ordered = F.sort_array(vals, asc=not largest)
    return F.struct(F.lit(n).alias("n"), F.slice(ordered, 1, n).alias("vals"))


def _float(v: Column) -> Column:
    x = v.cast("double")
    return F.when(F.isnan(x), F.raise_error(F.lit("NaN cannot be ranked")).cast("double")).otherwise(x)


def max_n(val: ColumnLike, n: int) -> Column:
    """Of any ordered type; nulls are left out."""
    return _cut(F.collect_list(col(val)), n, True)


def min_n(val: ColumnLike, n: int) -> Column:
    return _cut(F.collect_list(col(val)), n, False)


def max_n_float(val: ColumnLike, n: int) -> Column:
    """As max_n for doubles, with an error for NaN."""
    return max_n(_float(col(val)), n)


def min_n_float(val: ColumnLike, n: int) -> Column:
    return min_n(_float(col(val)), n)


def _pairs(val: ColumnLike, data: ColumnLike) -> Column:
    v = col(val)
    return F.collect_list(F.when(v.isNotNull(), F.struct(v.alias("val"), col(data).alias("data"))))


def max_n_by(val: ColumnLike, data: ColumnLike, n: int) -> Column:
    """The n largest values with their data; equal values are ordered by data, which must have an order."""
    return _cut(_pairs(val, data), n, True)


def min_n_by(val: ColumnLike, data: ColumnLike, n: int) -> Column:
    return _cut(_pairs(val, data), n, False)


def rollup_max(summary: ColumnLike) -> Column:
    """Merge max_n or max_n_by summaries; n is that of the smallest."""
    s = col(summary)
    n = F.min(s["n"])
    return F.struct(n.alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list(s["vals"])), asc=False), F.lit(1), n).alias("vals"))


def rollup_min(summary: ColumnLike) -> Column:
    s = col(summary)
    n = F.min(s["n"])
    return F.struct(n.alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list(s["vals"])), asc=True), F.lit(1), n).alias("vals"))


def into_array(s: ColumnLike) -> Column:
    return col(s)["vals"]


def into_values(s: ColumnLike) -> Column:
    """One row for each value; of by-forms a struct of val and data."""
    return F.explode(col(s)["vals"])


acc = Accessors(into_array, into_values)
