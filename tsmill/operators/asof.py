"""As-of joins: with each row of the right side, the last row of the left side at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsmill.functions.base import ColumnLike
from tsmill.functions.times import micros, micros_of


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: ColumnLike, right_ts: ColumnLike, columns: list[str], slice=None, tolerance=None) -> DataFrame:
    """All rows and columns of right, and `columns` of left from the last row whose time is not after (null if none, or
    if it lies more than tolerance back). Of left rows with equal times the one with the largest columns counts.

    Both sides are put in one line and the last left row is carried on by a window: one shuffle, no pairs. With slice, an
    interval, groups are cut by time: each slice carries on its own rows, and what it inherits comes from a table with
    one row for each group and slice, so that one hot key is spread over tasks.
    """
    taken = F.struct(*(F.col(c).alias(f"l{i}") for i, c in enumerate(columns)))
    kept = F.struct(*(F.col(c).alias(f"r{i}") for i, c in enumerate(right.columns)))
    names = {k: f"k{i}" for i, k in enumerate(keys)}
    by = lambda df: [F.col(k).alias(n) for k, n in names.items()]
    a = left.select(*by(left), micros(left_ts).alias("t"), F.lit(0).alias("side"), taken.alias("l")).where("t is not null")
    b = right.select(*by(right), micros(right_ts).alias("t"), F.lit(1).alias("side"), kept.alias("r"))
    both = a.withColumn("lt", F.col("t")).unionByName(b, allowMissingColumns=True)
    group = list(names.values())
    if slice is not None:
        both = both.withColumn("slice", F.floor(F.col("t") / micros_of(slice)))
        group.append("slice")
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy("t", "side", "l").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.struct("lt", "l")
    lined = both.withColumn("got", F.last(F.when(F.col("side") == 0, last), ignorenulls=True).over(w))
    if slice is not None:
        ends = both.where("side = 0").groupBy(*group).agg(F.max(F.struct("lt", "l")).alias("end"))
        every = both.select(*group).distinct().join(ends, [*group], "left") if group else ends
        earlier = Window.partitionBy(*([*names.values()] or [F.lit(0)])).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        inherited = every.withColumn("inherited", F.last("end", ignorenulls=True).over(earlier)).select(*(F.col(g).alias(f"_{g}") for g in group), "inherited")
        on = [lined[g].eqNullSafe(inherited[f"_{g}"]) for g in group]
        lined = lined.where("side = 1").join(inherited, on, "left").withColumn("got", F.coalesce("got", "inherited"))
    out = lined.where("side = 1")
    if tolerance is not None:
        out = out.withColumn("got", F.when(F.col("t") - F.col("got.lt") <= micros_of(tolerance), F.col("got")))
    mine = [F.col(f"r.r{i}").alias(c) for i, c in enumerate(right.columns)]
    theirs = [F.col(f"got.l.l{i}").alias(c if c not in right.columns else f"left_{c}") for i, c in enumerate(columns)]
    return out.select(*mine, *theirs)
