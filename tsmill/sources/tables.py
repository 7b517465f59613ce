"""Reading and writing: the test tables, generated series, and summaries as text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tsmill.functions.base import ColumnLike, col
from tsmill.functions.times import flat_micros, literal_micros


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, with times without a zone read as UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes))


def read(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options) -> DataFrame:
    """Any format Spark reads: parquet, orc, csv, json, text, jdbc."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", by: tuple[str, ...] = (), **options) -> None:
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def to_literal(summary: ColumnLike) -> Column:
    """A summary as JSON text, to be kept or sent by clients."""
    return F.to_json(col(summary), {"ignoreNullFields": "false"})


def from_literal(text: ColumnLike, schema: DataType | str) -> Column:
    """The summary that to_literal() wrote; schema is that of the summary's column."""
    return F.from_json(col(text), schema)


def _uniform(seed: int, stream: int) -> Column:
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), F.col("id")), 11)
    return (h.cast("double") + 0.5) / float(1 << 53)


def generate_periodic_normal_series(
    spark: SparkSession, start, length="28 days", interval="10 minutes", base: float = 1000.0, period="1 day", magnitude: float = 100.0, stddev: float = 100.0, seed: int = 0
) -> DataFrame:
    """Rows (time, value): a sine around base with normal noise; a row's value depends on its number and the seed alone,
    however rows are spread. The sine's argument is the time passed over 2 pi periods."""
    step, span, cycle = flat_micros(interval), flat_micros(length), flat_micros(period)
    rows = spark.range(max(0, -(-span // step)))
    passed = F.col("id") * step
    noise = F.sqrt(-2 * F.ln(_uniform(seed, 1))) * F.cos(2 * math.pi * _uniform(seed, 2)) * stddev
    value = F.lit(base) + magnitude * F.sin(passed / (2 * math.pi * cycle)) + noise
    return rows.select(F.timestamp_micros(literal_micros(start) + passed).alias("time"), value.alias("value"))
