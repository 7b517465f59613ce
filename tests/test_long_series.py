"""Elements of vectors and smoothing over long series."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from tsmill.functions import timevector as T
from tsmill.operators import downsampling as D
from tsmill.operators import sketches as K


def test_percentile_element_is_not_quadratic(spark):
    """60,000 values, nearly each in a bucket of its own: held one by one they took minutes."""
    df = spark.range(60_000).select(F.timestamp_micros("id").alias("ts"), F.exp((F.col("id") % 50_000 - 25_000) / 1000).alias("v"), (F.col("id") % 7).alias("k"))
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (0.0,), (-2.5,), (5e-324,), (-1e308,)], "v double").select(F.timestamp_micros(F.lit(1)).alias("ts"), "v", F.lit(9).cast("long").alias("k"))
    df = df.unionByName(odd)
    began = time.perf_counter()
    got = df.groupBy().agg(T.timevector("ts", "v").alias("v")).select((F.col("v") >> T.percentile_agg(200, 0.0001)).alias("sketch")).first()[0]
    assert time.perf_counter() - began < 40
    want = K.uddsketch(df, [], "v", 200, 0.0001).first()[0]
    assert got.buckets == want.buckets and got.compactions == want.compactions and got["count"] == 60_006
    few = df.where("k = 9").groupBy().agg(T.timevector("ts", "v").alias("v")).select((F.col("v") >> T.percentile_agg()).alias("sketch")).first()[0]
    assert few.buckets == K.percentile_agg(df.where("k = 9"), [], "v").first()[0].buckets and len(few.buckets) == 6


def test_hyperloglog_element_is_not_quadratic(spark):
    df = spark.range(200_000).select(F.timestamp_micros("id").alias("ts"), F.col("id").cast("double").alias("v"))
    began = time.perf_counter()
    got = df.groupBy().agg(T.timevector("ts", "v").alias("v")).select((F.col("v") >> T.hyperloglog(4096)).alias("sketch")).first()[0]
    assert time.perf_counter() - began < 40
    assert got == K.hyperloglog(df, [], "v", 4096).first()[0]


def test_smoothing_takes_few_points_to_python(spark, monkeypatch):
    r = np.random.default_rng(3)
    n = 4321
    val = np.sin(np.arange(n) / 90) + r.normal(0, 0.3, n)
    df = spark.createDataFrame([(int(t), float(x), int(t) // 1_000_000 % 2) for t, x in zip(np.arange(n) * 1_000_000, val)], "t long, v double, k long").withColumn("ts", F.timestamp_micros("t"))
    seen = []
    real = D.asap_column
    monkeypatch.setattr(D, "asap_column", lambda v, m: (seen.append(v), real(v, m))[1])
    y, before, width = D.smooth(val, 50)
    got = D.asap_smooth(df, [], "ts", "v", 50).first()["points"]
    assert before == 86 and len(got) == len(y)
    assert [p.ts for p in got] == [(k + width // 2) * before * 1_000_000 for k in range(len(y))]
    assert all(math.isclose(p.val, x, rel_tol=1e-9, abs_tol=1e-12) for p, x in zip(got, y))
    by = {row["k"]: row["points"] for row in D.asap_smooth(df, ["k"], "ts", "v", 50).collect()}
    for k in (0, 1):
        want = D.smooth(val[k::2], 50)[0]
        assert len(by[k]) == len(want) and all(math.isclose(p.val, x, rel_tol=1e-9, abs_tol=1e-12) for p, x in zip(by[k], want))
    means = D.asap_smooth(df, [], "ts", "v", 50)._jdf.queryExecution().optimizedPlan().toString()
    assert seen and "Window" in means  # the long series is averaged before it is collected
    short = df.where("t < 30000000")
    assert len(D.asap_smooth(short, [], "ts", "v", 50).first()["points"]) == len(D.smooth(val[:30], 50)[0])
    assert D.asap_smooth(short, [], "ts", "v", 0).first()["points"] == []
