"""Summaries over streams.

All summaries of tsmill.functions are plain aggregates, so they run in Structured Streaming: windowed() closes each
bucket once the watermark has passed it. ContinuousAggregate keeps a table of partial summaries, one part for each
micro-batch, that rollups read; writing a batch again replaces its part, so restarts change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(stream: DataFrame, ts: str, width: str, keys: list[str], aggregates: dict[str, Column], delay: str, slide: str | None = None) -> DataFrame:
    """Rows (bucket, keys, aggregates) of buckets that have closed: records up to `delay` late are put in their place,
    later ones are left out. aggregates: any of tsmill.functions, rows being sorted within each bucket as it closes."""
    bucket = F.window(ts, width, slide) if slide else F.window(ts, width)
    grouped = stream.withWatermark(ts, delay).groupBy(bucket.alias("w"), *keys)
    return grouped.agg(*(c.alias(k) for k, c in aggregates.items())).select(F.col("w.start").alias("bucket"), *keys, *aggregates)


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str], aggregates: dict[str, Column], delay: str) -> DataFrame:
    """As windowed(), for spans of activity that a silence of `gap` ends."""
    grouped = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys)
    return grouped.agg(*(c.alias(k) for k, c in aggregates.items())).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


class ContinuousAggregate:
    """A materialised aggregate: partial summaries by key columns, merged when read.

    aggregate: frame -> frame of keys and summaries; rollups: summary column -> function that merges it. Summaries that must
    not overlap in time (counters, gauges, time weights, states) need batches that do not.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], aggregate: Callable[[DataFrame], DataFrame], rollups: dict[str, Callable[[str], Column]]):
        self.spark, self.path, self.keys, self.aggregate, self.rollups = spark, path.rstrip("/"), keys, aggregate, rollups

    def write_batch(self, rows: DataFrame, batch: int) -> None:
        self.aggregate(rows).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        writer = stream.writeStream.foreachBatch(lambda rows, batch: self.write_batch(rows, batch)).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def partials(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")

    def read(self) -> DataFrame:
        return self.partials().groupBy(*self.keys).agg(*(f(c).alias(c) for c, f in self.rollups.items()))
