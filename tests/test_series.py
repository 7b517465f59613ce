import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tsmill.functions import expressions as X
from tsmill.functions import heartbeat, metrics, state, stats, timeweight
from tsmill.functions import timevector as tv
from tsmill.operators import asof, downsampling, ranking, series, sketches
from tsmill.sources import tables
from tsmill.streaming import aggregates


def T(text):
    return dt.datetime.fromisoformat(text)


def first(df):
    return df.first()[0]


@pytest.fixture(scope="module")
def events(spark):
    return tables.table(spark, "/root/testdata/sf0.001", "events").cache()


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)
    if hasattr(a, "asDict"):
        return all(close(x, y) for x, y in zip(a, b))
    if isinstance(a, list):
        return len(a) == len(b) and all(map(close, a, b))
    return a == b


@pytest.mark.parametrize("slice", [None, "3 days"])
def test_windows_and_folds_agree(events, slice):
    e = events.withColumn("state", F.col("event_type"))
    pairs = [
        (series.counter_agg(e, ["user_id"], "ts", "value", slice=slice), metrics.counter_agg("ts", "value")),
        (series.gauge_agg(e, ["user_id"], "ts", "value", slice=slice), metrics.gauge_agg("ts", "value")),
        (series.time_weight(e, ["user_id"], "linear", "ts", "value", slice=slice), timeweight.time_weight("linear", "ts", "value")),
    ]
    pairs.append((series.state_agg(e, ["user_id"], "ts", "state", slice=slice), state.state_agg("ts", "state")))
    for frame, agg in pairs:
        a = {r.user_id: r.summary for r in frame.collect()}
        b = {r.user_id: r.summary for r in e.groupBy("user_id").agg(agg.alias("summary")).collect()}
        assert a.keys() == b.keys() and all(close(a[k], b[k]) for k in a)


@pytest.mark.parametrize("slice", [None, "3 hours"])
def test_heartbeats_agree(events, slice):
    e = events.withColumn("start", F.date_trunc("day", "ts"))
    frame = series.heartbeat_agg(e, ["start"], "ts", "start", "1 day", "20 minutes", slice=slice)
    a = {r.start: r.summary for r in frame.collect()}
    b = {r.start: r.summary for r in e.groupBy("start").agg(heartbeat.heartbeat_agg("ts", "start", "1 day", "20 minutes").alias("summary")).collect()}
    assert a == b


@pytest.mark.parametrize("slice", [None, "1 day"])
def test_asof_join(spark, events, slice):
    left = events.where("event_id % 3 = 0").select("user_id", "ts", "value")
    right = events.where("event_id % 3 <> 0").select("user_id", "ts", "event_id")
    got = {r.event_id: r.value for r in asof.asof_join(left, right, ["user_id"], "ts", "ts", ["value"], slice=slice).collect()}
    ls = sorted((r.user_id, r.ts, r.value) for r in left.collect())
    want = {}
    for r in right.collect():
        before = [v for u, t, v in ls if u == r.user_id and t <= r.ts]
        want[r.event_id] = before[-1] if before else None
    assert got == want


def vector(spark, values, step=86400):
    us = lambda i: (i * step) * 1_000_000
    return spark.createDataFrame([([(us(i), v) for i, v in enumerate(values)],)], "v array<struct<ts: long, val: double>>")


def vals(df, pipeline):
    return [p.val for p in first(df.select(F.col("v") >> pipeline))]


def test_pipelines(spark):
    df = vector(spark, [10.0, 25.0, 20.0, 92.0, 30.8, 30.8, 30.8, 30.9, -427.2])
    assert vals(df, tv.delta()) == [15.0, -5.0, 72.0, -61.2, 0.0, 0.0, 0.09999999999999787, -458.09999999999997]
    step = vector(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    assert vals(step, tv.map("$value * $value") >> tv.delta()) == [3.0, 5.0, 7.0, 9.0]
    assert vals(step, tv.filter("$value > 2 and not ($value = 4)")) == [3.0, 5.0]
    assert vals(step, tv.mul(2) >> tv.add(1) >> tv.mod(4)) == [3.0, 1.0, 3.0, 1.0, 3.0]
    assert vals(step, tv.sub(3) >> tv.div(0))[0] == -math.inf and math.isnan(vals(step, tv.sub(3) >> tv.div(0))[2])
    odd = vector(spark, [-0.0, 0.0, -2.5, 2.5, 1e300, -1.5])
    assert vals(odd, tv.sign()) == [-1.0, 1.0, -1.0, 1.0, 1.0, -1.0]
    assert vals(odd, tv.round())[2:] == [-3.0, 3.0, 1e300, -2.0] and vals(odd, tv.trunc())[2:4] == [-2.0, 2.0] and vals(odd, tv.ceil())[2:5] == [-2.0, 3.0, 1e300]
    logs = vals(odd, tv.ln())
    assert logs[1] == -math.inf and math.isnan(logs[2]) and math.isclose(logs[3], math.log(2.5))
    assert math.isclose(vals(step, tv.logn(3))[2], 1.0) and vals(step, tv.power(2))[4] == 25.0 and math.isclose(vals(step, tv.map_data(F.exp))[0], math.e)
    assert first(step.select(F.col("v") >> tv.sum())) == 15.0 and first(step.select(F.col("v") >> (tv.add(1) >> tv.average()))) == 4.0
    assert first(step.select(stats.stddev(F.col("v") >> tv.stats_agg(), "pop"))) == math.sqrt(2)
    assert first(step.select(metrics.delta(F.col("v") >> tv.counter_agg()))) == 4.0 and first(step.select(F.col("v") >> tv.num_vals())) == 5
    assert abs(first(step.select(sketches.udd_percentile(F.col("v") >> tv.percentile_agg(), 0.5))) - 3) < 0.01
    assert first(step.select(sketches.distinct_count(F.col("v") >> tv.hyperloglog(64)))) == 5
    unsorted = spark.createDataFrame([([(2, 1.0), (1, 2.0), (3, None)],)], "v array<struct<ts: long, val: double>>")
    assert [p.ts for p in first(unsorted.select(F.col("v") >> tv.sort()))] == [1, 2, 3]
    for bad in (tv.delta(), tv.sum()):
        with pytest.raises(Exception, match="sorted and free of nulls"):
            unsorted.select(F.col("v") >> bad).collect()
    assert len(step.select(tv.unnest("v")).collect()) == 5
    assert first(step.select(tv.to_plotly("v"))).startswith('{"times":["1970-01-01 00:00:00')
    assert first(step.select(tv.to_text("v", "v={{VALUES}}"))) == "v=[1.0,2.0,3.0,4.0,5.0]"


def test_fill_to(spark, events):
    df = vector(spark, [0.0, 4.0], step=4 * 3600)
    assert vals(df, tv.fill_to("1 hour", "linear")) == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert vals(df, tv.fill_to("1 hour", "locf")) == [0.0, 0.0, 0.0, 0.0, 4.0] and vals(df, tv.fill_to("1 hour", "nearest")) == [0.0, 0.0, 0.0, 4.0, 4.0]
    for m in ("locf", "linear", "nearest"):
        a = series.fill_to(events, ["user_id"], "ts", "value", "1 day", m).orderBy("user_id", "time").collect()
        b = events.groupBy("user_id").agg(tv.timevector("ts", "value").alias("v")).select("user_id", tv.unnest(F.col("v") >> tv.fill_to("1 day", m))).orderBy("user_id", "time").collect()
        assert [tuple(x)[:2] for x in a] == [tuple(x)[:2] for x in b] and np.allclose([x.value for x in a], [x.value for x in b])


def test_slices_do_not_show(events):
    key = lambda d: sorted((r.user_id, r.time, round(r.value, 9)) for r in d.collect())
    for m in ("locf", "linear", "nearest"):
        assert key(series.fill_to(events, ["user_id"], "ts", "value", "1 day", m)) == key(series.fill_to(events, ["user_id"], "ts", "value", "1 day", m, slice="2 days"))
    assert key(series.delta(events, ["user_id"], "ts", "value")) == key(series.delta(events, ["user_id"], "ts", "value", slice="1 day"))


def test_asof_of_vectors(spark):
    df = spark.createDataFrame([([(2, 1.0), (4, 2.0)], [(1, 5.0), (4, 6.0), (9, 7.0)])], "a array<struct<ts: long, val: double>>, b array<struct<ts: long, val: double>>")
    assert [tuple(r)[:2] for r in first(df.select(tv.asof("a", "b")))] == [(None, 5.0), (2.0, 6.0), (2.0, 7.0)]


def test_asof_of_long_vectors_with_ties(spark):
    r = np.random.default_rng(5)
    points = lambda n, most: [(int(t), float(v)) for t, v in zip(r.integers(0, most, n), r.normal(size=n))]
    kind = "a array<struct<ts: long, val: double>>, b array<struct<ts: long, val: double>>"
    pairs = [(points(n, most), points(m, most)) for n, m, most in ((1, 1, 3), (7, 5, 4), (1025, 300, 700), (6000, 6000, 9000))]
    got = spark.createDataFrame(pairs, kind).select(tv.asof("a", "b").alias("out")).collect()
    for (a, b), row in zip(pairs, got):
        a.sort()
        times = [t for t, _ in a]
        want = [(a[i - 1][1] if (i := int(np.searchsorted(times, t, "right"))) else None, v) for t, v in sorted(b)]
        assert [(x.value1, x.value2) for x in row.out] == want


def test_percentile_element_is_the_grouped_sketch(spark):
    r = np.random.default_rng(6)
    rows = [(k, i, float(v)) for k in range(3) for i, v in enumerate(np.concatenate([r.normal(size=400) * 50, np.zeros(9), r.lognormal(0, 4, 300)]))]
    df = spark.createDataFrame(rows, "k int, t long, val double")
    vector = df.groupBy("k").agg(F.collect_list(F.struct(F.col("t").alias("ts"), "val")).alias("v")).withColumn("sketch", F.col("v") >> tv.percentile_agg(60, 0.01))
    for x in vector.join(sketches.uddsketch(df, ["k"], "val", 60, 0.01, "other"), "k").collect():
        assert x.sketch.buckets == x.other.buckets and x.sketch["count"] == 709 and x.sketch.compactions == x.other.compactions > 0


def test_expressions(spark):
    one = spark.range(1)
    run = lambda f, text, x=2.0: first(one.select(f(text, T("2020-01-01"), x)))
    assert run(X.f64_lambda, "1 + 2 * 3 ^ 2 ^ 1 - 4 / 2") == 17.0 and run(X.f64_lambda, "let $a = $value + 1; let $b = $a * $a; $b - 1") == 8.0
    assert run(X.f64_lambda, "-$value ^ 2") == 4.0 and run(X.f64_lambda, "log(8, 2) + atan2(0, 1) + pi() - pi() + round(-2.5)") == 0.0
    assert run(X.bool_lambda, "$value = 2 or 1 / 0 > 3") is True and run(X.bool_lambda, "not ($value >= 2) and true") is False
    assert run(X.bool_lambda, "($value, 1) = (2, 1)") is True
    assert run(X.ttz_lambda, "$time + '1 day 2 hours'i * 2") == T("2020-01-03 04:00:00")
    assert run(X.interval_lambda, "'2020-01-02't - $time") == 86_400_000_000
    assert tuple(run(X.point_lambda, "($time + '1 second'i, $value / 4)")) == (1577836801000000, 0.5)
    assert run(X.trace_lambda, "$value") == 'double: {"result":2.0}'
    for bad in ("$nope", "1 +", "1 and 2", "'x", "$time * 2", "foo(1)", "let $time = 1; 2", "(1, 2) < (3, 4)"):
        with pytest.raises(X.LambdaError):
            X.compile(bad, F.lit(1), F.lit(1.0))


def plain_lttb(ts, val, n):
    size = len(ts)
    if n >= size:
        return list(range(size))
    every, out = (size - 2) / (n - 2), [0]
    for i in range(n - 2):
        lo, hi, end = int(i * every) + 1, int((i + 1) * every) + 1, min(int((i + 2) * every) + 1, size)
        mt, mv = sum(ts[hi:end]) // (end - hi), sum(val[hi:end]) / (end - hi)
        a = out[-1]
        areas = [abs((ts[a] - mt) * (val[k] - val[a]) - (ts[a] - ts[k]) * (mv - val[a])) / 2 for k in range(lo, hi)]
        out.append(lo + areas.index(max(areas)))
    return [*out, size - 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=3, max_size=200), st.integers(3, 50))
def test_largest_triangles(values, n):
    ts = np.cumsum(np.abs(np.array(values)) + 1)
    val = np.array(values, float)
    assert downsampling.largest_triangles(ts, val, n).tolist() == plain_lttb(ts.tolist(), val.tolist(), n)


def test_downsampling(spark):
    rows = spark.range(101).select((F.lit(1.0) + F.col("id") / 10).alias("foo"))
    day = (F.round(F.col("foo") * 10)).cast("int")
    df = rows.select((F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(days=day)).alias("ts"), (F.lit(10.0) + 5 * F.cos("foo")).alias("v"), F.lit(1).alias("k"))
    got = first(downsampling.lttb(df, ["k"], "ts", "v", 34).select("points"))
    assert len(got) == 34
    start = T("2020-01-01")
    assert [((p.ts - 1577836800000000) // 86_400_000_000 + 1, round(p.val, 2)) for p in got[:3]] == [(11, 12.7), (13, 11.81), (15, 10.85)] and start
    g = first(downsampling.gp_lttb(df.where(day.isNotNull() & ((F.col("v") < 9) | (F.col("v") > 11))), ["k"], "ts", "v", 20, "1 day").select("points"))
    assert 10 <= len(g) <= 24 and g[0].ts == got[0].ts
    x = np.sin(np.arange(2000) / 30) + np.random.default_rng(1).normal(size=2000)
    y, before, width = downsampling.smooth(x, 100)
    assert before == 20 and len(y) == 100 - width + 1 and downsampling._roughness(y) <= downsampling._roughness(downsampling._means(x, 20, 20))
    assert len(first(downsampling.asap_smooth(df, ["k"], "ts", "v", 30).select("points"))) > 20


def test_top_n(events):
    got = {r.user_id: r.summary.vals for r in ranking.top_n(events, ["user_id"], "value", 3).collect()}
    want = {}
    for r in events.collect():
        want.setdefault(r.user_id, []).append(r.value)
    assert got == {k: sorted(v, reverse=True)[:3] for k, v in want.items()}
    low = ranking.top_n(events, [], "value", 2, largest=False, data="event_id")
    assert [x.val for x in first(low).vals] == sorted(v for vs in want.values() for v in vs)[:2]


def test_generated_series_and_literals(spark):
    a = tables.generate_periodic_normal_series(spark, "2020-01-01", "2 days", "1 hour", seed=7)
    assert a.count() == 48 and a.orderBy("time").collect() == tables.generate_periodic_normal_series(spark, "2020-01-01", "2 days", "1 hour", seed=7).repartition(5).orderBy("time").collect()
    s = a.agg(metrics.counter_agg("time", "value").alias("s"))
    back = s.select(tables.from_literal(tables.to_literal("s"), s.schema["s"].dataType).alias("s"))
    assert first(back) == first(s)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    r = random.Random(1)
    rows = [(T("2024-01-01") + dt.timedelta(minutes=i), i % 3, r.random()) for i in range(300)]
    spark.createDataFrame(rows, "ts timestamp, k long, v double").repartition(3).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, k long, v double").option("maxFilesPerTrigger", 1).parquet(src)
    plain = spark.read.parquet(src)
    aggs = {"c": metrics.counter_agg("ts", "v"), "s": stats.stats_agg("v")}
    q = aggregates.windowed(stream, "ts", "1 hour", ["k"], aggs, "1 day").writeStream.format("memory").queryName("closed").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(x.bucket, x.k): x.c for x in spark.table("closed").collect()}
    want = {(x.b, x.k): x.c for x in plain.groupBy(F.window("ts", "1 hour")["start"].alias("b"), "k").agg(aggs["c"].alias("c")).collect()}
    assert got == want
    cagg = aggregates.ContinuousAggregate(spark, str(tmp_path / "agg"), ["k"], lambda d: d.groupBy("k").agg(stats.stats_agg("v").alias("s")), {"s": stats.rollup})
    q = cagg.start(stream, str(tmp_path / "ckpt"), availableNow=True)
    q.awaitTermination()
    got = {x.k: x[1] for x in cagg.read().select("k", stats.average("s")).collect()}
    assert all(math.isclose(got[x.k], x.m) for x in plain.groupBy("k").agg(F.avg("v").alias("m")).collect())
