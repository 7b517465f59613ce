"""The n largest or smallest rows of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsmill.functions.base import need, own_keys


@own_keys
def top_n(df: DataFrame, keys: list[str], val: str, n: int, largest: bool = True, data: str | None = None, name: str = "summary") -> DataFrame:
    """An nmost summary for each group (see tsmill.functions.nmost). Limits apply within each partition before rows
    meet, so a group of any size sends n rows from each."""
    need(n > 0, "n must be positive")
    columns = [val] if data is None else [val, data]
    order = [F.desc(c) if largest else F.asc(c) for c in columns]
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    rows = df.where(F.col(val).isNotNull()).select(*keys, *dict.fromkeys(columns)).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    item = F.col(val) if data is None else F.struct(F.col(val).alias("val"), F.col(data).alias("data"))
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    listed = grouped.agg(F.array_sort(F.collect_list(F.struct(F.col("__rn").alias("rn"), item.alias("x")))).alias("xs"))
    return listed.where(F.size("xs") > 0).select(*keys, F.struct(F.lit(n).alias("n"), F.transform("xs", lambda r: r["x"]).alias("vals")).alias(name))


def row_limit(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group in an order."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
