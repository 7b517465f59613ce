from pyspark.sql import functions as F

from tsmill.functions import stats
from tsmill.functions.base import salted_rollup
from tsmill.operators import series
from tsmill.sources import tables


def test_formats_round_trip(spark, tmp_path):
    df = spark.range(50).select("id", (F.col("id") * 0.5).alias("v"), F.concat(F.lit("k"), F.col("id") % 3).alias("k"))
    for kind in ("parquet", "orc", "json"):
        tables.write(df, str(tmp_path / kind), kind, by=("k",))
        back = tables.read(spark, str(tmp_path / kind), kind, schema=df.schema)
        assert sorted(map(tuple, back.select("id", "v", "k").collect())) == sorted(map(tuple, df.collect()))
    tables.write(df, str(tmp_path / "csv"), "csv", header="true")
    assert tables.read(spark, str(tmp_path / "csv"), "csv", schema=df.schema, header="true").agg(F.sum("v")).first()[0] == df.agg(F.sum("v")).first()[0]


def test_salted_rollup_is_the_rollup(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.col("id") % 300).alias("part"), F.sin("id").alias("v"))
    parts = df.groupBy("k", "part").agg(stats.stats_agg("v").alias("s"))
    a = {r.k: r.x for r in salted_rollup(parts, ["k"], "s", stats.rollup).select("k", stats.kurtosis("s").alias("x")).collect()}
    b = {r.k: r.x for r in df.groupBy("k").agg(stats.stats_agg("v").alias("s")).select("k", stats.kurtosis("s").alias("x")).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_keys_may_have_any_name(spark):
    df = spark.range(20).select(F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"), F.col("id").cast("double").alias("value"), *((F.col("id") % 2).alias(n) for n in ("t", "v", "b", "n", "slice")))
    out = series.counter_agg(df, ["t", "v", "b", "n"], "ts", "value", slice="5 seconds")
    assert out.columns == ["t", "v", "b", "n", "summary"] and out.count() == 2
    assert series.heartbeat_agg(df.withColumn("start", F.timestamp_micros(F.lit(0))), ["b", "n"], "ts", "start", "1 minute", "5 seconds").count() == 2


def test_range_window(spark):
    df = spark.range(10).select(F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"), F.lit(1).alias("k"))
    got = df.select(F.count("*").over(series.range_window(["k"], "ts", "3 seconds")).alias("n")).collect()
    assert sorted(r.n for r in got) == [1, 2, 3, *[4] * 7]
