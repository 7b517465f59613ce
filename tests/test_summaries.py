"""Worked examples of the summaries, over small literal tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tsmill.functions import candlestick, heartbeat, metrics, nmost, state, stats, times, timeweight


def T(text):
    return dt.datetime.fromisoformat(text)


def first(df):
    return df.first()[0]


@pytest.fixture(scope="module")
def hourly(spark):
    """10,001 hourly values 100 + i % 100."""
    start = F.lit("2020-01-01").cast("timestamp")
    return spark.range(10001).select((start + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"), (F.lit(100.0) + F.col("id") % 100).alias("val"))


def test_counter_and_average_of_a_long_series(hourly):
    r = hourly.agg(metrics.counter_agg("ts", "val").alias("c"), timeweight.time_weight("locf", "ts", "val").alias("w"), stats.stats_agg("val").alias("s"))
    r = r.select(metrics.num_resets("c"), timeweight.average("w"), stats.kurtosis("s"), F.col("c") >> metrics.acc.num_elements()).first()
    assert r[0] == 100 and math.isclose(r[1], 149.5) and math.isclose(r[2], 1.7995661075080858, rel_tol=1e-10) and r[3] == 10001


def points(spark, values, start="2020-01-01 00:00:00", step=60):
    t = T(start)
    return spark.createDataFrame([(t + dt.timedelta(seconds=step * i), float(v)) for i, v in enumerate(values)], "ts timestamp, val double")


def test_counter(spark):
    df = points(spark, [10, 20, 30, 20, 10, 20, 10, 30, 10])
    s = df.agg(metrics.counter_agg("ts", "val").alias("s"))
    x = s.select(metrics.delta("s"), metrics.num_resets("s"), metrics.num_changes("s"), metrics.idelta_left("s"), metrics.idelta_right("s"), F.col("s.n"), F.col("s.sx"), metrics.rate("s"), metrics.irate_right("s")).first()
    # resets: 30>20>10, 20>10, 30>10
    assert x[:7] == (30 + 20 + 20 + 30 + 10 - 10, 4, 8, 10.0, 10.0, 9, 5680370160.0)
    assert math.isclose(x[7], 100 / 480) and math.isclose(x[8], 10 / 60)
    g = df.agg(metrics.gauge_agg("ts", "val").alias("s")).select(metrics.delta("s"), metrics.num_changes("s")).first()
    assert g == (0.0, 8)


def test_counter_rollup_is_the_whole(spark):
    df = points(spark, [10, 20, 30, 20, 10, 20, 10, 30, 10, 40, 40, 2])
    whole = df.agg(metrics.counter_agg("ts", "val").alias("s"))
    parts = df.groupBy(times.time_bucket("3 minutes", "ts").alias("b")).agg(metrics.counter_agg("ts", "val").alias("s")).agg(metrics.rollup_counter("s").alias("s"))
    a, b = first(whole), first(parts)
    for k in ("first", "second", "penultimate", "last", "reset_sum", "num_resets", "num_changes", "n"):
        assert a[k] == b[k], k
    for k in ("slope", "intercept", "corr"):
        f = getattr(metrics, k)
        assert math.isclose(first(whole.select(f("s"))), first(parts.select(f("s"))), rel_tol=1e-6)
    clash = df.agg(metrics.counter_agg("ts", "val").alias("s"))
    with pytest.raises(Exception, match="overlap"):
        clash.union(clash).agg(metrics.rollup_counter("s")).collect()


def test_extrapolation(spark):
    df = points(spark, [10, 20, 30, 40])
    limits = times.bounds("2020-01-01 00:00:00", "2020-01-01 00:04:00")
    s = df.agg(metrics.with_bounds(metrics.counter_agg("ts", "val"), limits).alias("s"))
    d, r = s.select(metrics.extrapolated_delta("s"), metrics.extrapolated_rate("s")).first()
    want = 30 * (180 + 0 + 59.999) / 180
    assert math.isclose(d, want) and math.isclose(r, want / 239.999)
    with pytest.raises(Exception, match="bounds"):
        df.agg(metrics.extrapolated_delta(metrics.counter_agg("ts", "val"))).collect()


def test_interpolated_counter_covers_all_change(spark):
    df = points(spark, [10, 20, 30, 40, 50, 5, 15], step=3600)
    b = times.time_bucket("3 hours", "ts").alias("b")
    w = Window.orderBy("b")
    s = df.groupBy(b).agg(metrics.counter_agg("ts", "val").alias("s")).select("*", F.lag("s").over(w).alias("p"), F.lead("s").over(w).alias("n"))
    got = [r[0] for r in s.select("b", metrics.interpolated_delta("s", F.col("b"), "3 hours", "p", "n").alias("d")).orderBy("b").select("d").collect()]
    assert [round(x, 9) for x in got] == [30.0, 10 + 5 + 10, 0.0]
    rates = s.orderBy("b").select(metrics.interpolated_rate("s", F.col("b"), "3 hours", "p", "n")).collect()
    assert math.isclose(rates[0][0], 30 / 10800) and rates[2][0] is None


WEIGHTED = [
    ("2020-01-01 08:00:00", 10.0), ("2020-01-01 12:00:00", 40.0), ("2020-01-01 16:00:00", 20.0), ("2020-01-02 02:00:00", 15.0), ("2020-01-02 12:00:00", 50.0),
    ("2020-01-02 20:00:00", 25.0), ("2020-01-03 10:00:00", 30.0), ("2020-01-03 12:00:00", 0.0), ("2020-01-03 16:00:00", 35.0),
]


def test_time_weight(spark):
    df = spark.createDataFrame([(T(t), v, T(t[:10])) for t, v in WEIGHTED], "ts timestamp, val double, bucket timestamp")
    w = Window.orderBy("bucket")
    s = df.groupBy("bucket").agg(timeweight.time_weight("Linear", "ts", "val").alias("s")).select("*", F.lag("s").over(w).alias("p"), F.lead("s").over(w).alias("n")).orderBy("bucket")
    got = [r[0] for r in s.select(timeweight.interpolated_integral("s", F.col("bucket"), "1 day", F.col("p"), F.col("n"), "hours")).collect()]
    assert [round(x, 9) for x in got] == [364.0, 758.857142857, 382.142857143]
    assert [r[0] for r in s.select(timeweight.integral("s", "hrs")).collect()] == [220.0, 625.0, 100.0]
    whole = first(df.agg(timeweight.time_weight("linear", "ts", "val").alias("s")).select(timeweight.average("s")))
    assert math.isclose(first(s.agg(timeweight.rollup("s").alias("s")).select(timeweight.average("s"))), whole)
    one = df.limit(1).agg(timeweight.time_weight("locf", "ts", "val").alias("s")).select(timeweight.average("s"), timeweight.integral("s")).first()
    assert one == (None, 0.0)
    with pytest.raises(ValueError):
        timeweight.time_weight("cubic", "ts", "val")


STATES = [("START", "00:00:00"), ("OK", "00:00:11"), ("ERROR", "00:01:00"), ("OK", "00:01:03"), ("STOP", "00:02:00")]


def test_states(spark):
    df = spark.createDataFrame([(T(f"2020-01-01 {t}"), s) for s, t in STATES], "ts timestamp, state string")
    s = df.agg(state.state_agg("ts", "state").alias("s"))
    rows = s.select(state.state_timeline("s")).collect()
    assert [(r[0], r[1].strftime("%M:%S"), r[2].strftime("%M:%S")) for r in rows] == [("START", "00:00", "00:11"), ("OK", "00:11", "01:00"), ("ERROR", "01:00", "01:03"), ("OK", "01:03", "02:00"), ("STOP", "02:00", "02:00")]
    assert first(s.select(state.duration_in("s", "ERROR"))) == 3_000_000
    assert first(s.select(state.duration_in("s", "OK", "2020-01-01 00:00:15", "30 seconds"))) == 30_000_000
    assert first(s.select(state.duration_in("s", "OK", "2020-01-01 00:00:59"))) == 58_000_000
    assert dict(s.select(state.into_values("s")).collect()) == {"START": 11_000_000, "OK": 106_000_000, "ERROR": 3_000_000, "STOP": 0}
    assert [first(s.select(state.state_at("s", f"2020-01-01 {t}"))) for t in ("00:00:05", "00:01:00", "00:05:00")] == ["START", "ERROR", "STOP"]
    assert first(s.select(state.state_at("s", "2019-12-31"))) is None
    assert len(s.select(state.state_periods("s", "OK")).collect()) == 2
    c = df.agg(state.compact_state_agg("ts", "state").alias("c"))
    assert first(c.select(state.compact_duration_in("c", "OK"))) == 106_000_000 and first(c.select(state.compact_duration_in("c", "none"))) == 0
    parts = df.groupBy(times.time_bucket("1 minute", "ts").alias("b")).agg(state.state_agg("ts", "state").alias("s"))
    assert first(parts.agg(state.rollup("s").alias("s"))) == first(s)
    i = s.select(state.interpolate("s", "2019-12-31 23:59:50", "3 minutes").alias("s"))
    assert first(i.select(state.duration_in("s", "STOP"))) == 50_000_000
    before = spark.createDataFrame([(T("2019-12-31 23:59:00"), "DOWN")], "ts timestamp, state string").agg(state.state_agg("ts", "state").alias("p"))
    both = s.crossJoin(before)
    assert first(both.select(state.interpolated_duration_in("s", "DOWN", "2019-12-31 23:59:50", "3 minutes", F.col("p")))) == 10_000_000
    with pytest.raises(Exception, match="two states"):
        df.union(spark.createDataFrame([(T("2020-01-01"), "X")], df.schema)).agg(state.state_agg("ts", "state")).collect()
    ints = df.select("ts", F.length("state").alias("state")).agg(state.state_agg("ts", "state").alias("s"))
    assert first(ints.select(state.duration_in("s", 2))) == 106_000_000


def test_heartbeats(spark):
    m = lambda *a: [T(f"2020-01-01 0{h}:{x:02d}:00") for h, x in a]
    beats = m((0, 2), (0, 8), (0, 9), (0, 25), (0, 55))
    df = spark.createDataFrame([(b, T("2020-01-01")) for b in beats], "hb timestamp, start timestamp")
    s = df.agg(heartbeat.heartbeat_agg("hb", "start", "1 hour", "10 minutes").alias("s"))
    minutes = 60_000_000
    assert first(s.select(heartbeat.uptime("s"))) == (17 + 10 + 5) * minutes and first(s.select(heartbeat.downtime("s"))) == 28 * minutes
    assert [(a.minute, b.minute) for a, b in s.select(heartbeat.live_ranges("s")).collect()] == [(2, 19), (25, 35), (55, 0)]
    assert [(a.minute, b.minute) for a, b in s.select(heartbeat.dead_ranges("s")).collect()] == [(0, 2), (19, 25), (35, 55)]
    assert s.select(heartbeat.num_live_ranges("s"), heartbeat.num_gaps("s")).first() == (3, 3)
    assert s.select(heartbeat.live_at("s", "2020-01-01 00:18:59"), heartbeat.live_at("s", "2020-01-01 00:19:00")).first() == (True, False)
    late = spark.createDataFrame([(T("2020-01-01 01:30:00"), T("2020-01-01 01:00:00"))], df.schema).agg(heartbeat.heartbeat_agg("hb", "start", "1 hour", "10 minutes").alias("s"))
    both = late.select(F.col("s").alias("n")).crossJoin(s)
    assert first(both.select(heartbeat.interpolated_uptime("n", "s"))) == 15 * minutes
    assert first(s.union(late).agg(heartbeat.rollup("s").alias("s")).select(heartbeat.uptime("s"))) == 42 * minutes
    t = s.select(heartbeat.trim_to("s", "2020-01-01 00:10:00", "20 minutes").alias("s"))
    assert first(t.select(heartbeat.uptime("s"))) == 14 * minutes
    with pytest.raises(Exception, match="outside"):
        df.agg(heartbeat.heartbeat_agg("hb", "start", "30 minutes", "10 minutes")).collect()


def test_candlesticks(spark):
    rows = [("2022-08-01 00:00:00", 133.445, 20), ("2022-08-01 00:00:00", 133.445, 5), ("2022-08-01 00:00:01", 133.44, 5), ("2022-08-01 00:00:02", 133.445, 0)]
    df = spark.createDataFrame([(T(t), p, v) for t, p, v in rows], "ts timestamp, price double, vol int")
    s = df.agg(candlestick.candlestick_agg("ts", "price", "vol").alias("s"))
    c = candlestick
    assert s.select(c.open("s"), c.high("s"), c.low("s"), c.close("s"), c.volume("s")).first() == (133.445, 133.445, 133.44, 133.445, 30.0)
    assert first(s.select(c.high_time("s"))) == T("2022-08-01 00:00:00") and first(s.select(c.close_time("s"))) == T("2022-08-01 00:00:02")
    assert math.isclose(first(s.select(c.vwap("s"))), (133.445 * 25 + 133.44 * 5) / 30)
    none = df.union(spark.createDataFrame([(T("2022-08-02"), 1.0, None)], df.schema)).agg(c.candlestick_agg("ts", "price", "vol").alias("s"))
    assert none.select(c.volume("s"), c.vwap("s"), c.low("s")).first() == (None, None, 1.0)
    parts = df.groupBy(F.second("ts").alias("k")).agg(c.candlestick_agg("ts", "price", "vol").alias("s")).agg(c.rollup("s").alias("s"))
    assert first(parts) == first(s)
    one = spark.range(1).select(c.candlestick(F.lit(T("2022-08-01")), F.lit(1.0), F.lit(4.0), F.lit(0.5), F.lit(2.0), 10).alias("s"))
    assert math.isclose(first(one.select(c.vwap("s"))), (4 + 0.5 + 2) / 3)


def test_nmost(spark):
    df = spark.range(100).select((F.col("id") * 83 % 100).alias("v"), (F.col("id") % 4).alias("k"))
    s = df.agg(nmost.max_n("v", 5).alias("a"), nmost.min_n("v", 3).alias("b"), nmost.max_n_by("v", "k", 2).alias("c"))
    r = s.first()
    assert r.a.vals == [99, 98, 97, 96, 95] and r.b.vals == [0, 1, 2] and [x.val for x in r.c.vals] == [99, 98]
    parts = df.groupBy("k").agg(nmost.max_n("v", 5).alias("a")).agg(nmost.rollup_max("a").alias("a"))
    assert first(parts.select(nmost.into_array("a"))) == [99, 98, 97, 96, 95]
    assert [x[0] for x in s.select(nmost.into_values("b")).collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="NaN"):
        spark.range(1).agg(nmost.max_n_float(F.lit(float("nan")), 1)).collect()


def test_stats_rollup_and_definitions(spark):
    r = spark.range(1, 201).select((F.col("id") % 17).cast("double").alias("x"), F.sin("id").alias("y"), (F.col("id") % 5).alias("k"))
    whole = r.agg(stats.stats_agg("y", "x").alias("s"))
    parts = r.groupBy("k").agg(stats.stats_agg("y", "x").alias("s")).agg(stats.rollup_2d("s").alias("s"))
    names = ["average_x", "average_y", "stddev_x", "stddev_y", "skewness_x", "skewness_y", "kurtosis_x", "kurtosis_y", "slope", "intercept", "x_intercept", "corr", "determination_coeff", "covariance"]
    a, b = (d.select(*(getattr(stats, n)("s").alias(n) for n in names)).first() for d in (whole, parts))
    for n in names:
        assert math.isclose(a[n], b[n], rel_tol=1e-9), n
    v = [x.y for x in r.collect()]
    m = sum(v) / 200
    s2 = sum((x - m) ** 2 for x in v) / 199
    assert math.isclose(a["skewness_y"], sum((x - m) ** 3 for x in v) / 199 / s2**1.5, rel_tol=1e-9)
    assert math.isclose(a["kurtosis_y"], sum((x - m) ** 4 for x in v) / 199 / s2**2, rel_tol=1e-9)
    one = spark.range(1).agg(stats.stats_agg(F.lit(2.0)).alias("s"), stats.stats_agg(F.lit(2.0), F.lit(1.0)).alias("t"))
    x = one.select(stats.variance("s"), stats.variance_x("t"), stats.corr("t"), stats.average("s")).first()
    assert math.isnan(x[0]) and x[1:] == (None, None, 2.0)
    flat = spark.range(3).agg(stats.stats_agg(F.lit(5.0), F.col("id")).alias("s")).select(stats.slope("s"), stats.determination_coeff("s"), stats.x_intercept("s"), stats.corr("s")).first()
    assert flat == (0.0, 1.0, None, None)
    empty = r.where("x < 0").agg(stats.stats_agg("x").alias("s")).select(stats.num_vals("s"), stats.average("s"), stats.stddev("s")).first()
    assert empty == (0, None, None)


def test_times(spark):
    one = spark.range(1)
    get = lambda c: first(one.select(c))
    ts = F.lit(T("2020-06-10 10:00:00"))
    assert get(times.time_bucket("1 week", ts)) == T("2020-06-08") and get(times.time_bucket("1 month", ts)) == T("2020-06-01")
    assert get(times.time_bucket_range("1 day", ts)) == (T("2020-06-10"), T("2020-06-11"))
    assert get(times.days_in_month(F.lit(T("2021-02-05")))) == 28
    assert math.isclose(get(times.month_normalize(F.lit(1000.0), F.lit(T("2021-01-01")))), 1000 * (365.25 / 12) / 31)
    assert get(times.to_epoch(F.lit(T("2021-01-01")))) == 1609459200.0
    big = (1 << 31) - 1
    assert [get(f(F.lit(a), F.lit(b))) for f, a, b in ((times.saturating_add, big, 5), (times.saturating_sub, -big, 5), (times.saturating_add_pos, 3, -5), (times.saturating_sub_pos, 3, 5), (times.saturating_mul, big, -2))] == [big, -big - 1, 0, 0, -big - 1]
    assert get(times.as_interval(F.lit(93_784_500_000))) == dt.timedelta(days=1, hours=2, minutes=3, seconds=4.5)
    assert times.split_interval("1 year 2 months 3 days 04:05:06.5") == (14, ((3 * 24 + 4) * 3600 + 5 * 60 + 6) * 1_000_000 + 500_000)
