"""The SQL front end, on queries of the kinds that the summaries are made for."""

import math

import pytest

from tsmill.plans.sql import SqlError, sql
from tsmill.sources import tables


@pytest.fixture(scope="module")
def run(spark):
    tables.table(spark, "/root/testdata/sf0.001", "events").createOrReplaceTempView("ev")

    def go(text):
        return [tuple(r) for r in (spark.sql(text) if " WINDOW " in text else sql(spark, text)).collect()]

    return go


def test_two_steps_and_arrows(run):
    a = run("SELECT user_id, rate(counter_agg(ts, value)) AS r, count(*) AS n FROM ev GROUP BY user_id ORDER BY user_id")
    b = run("SELECT user_id, counter_agg(ts, value) -> rate() AS r, count(*) AS n FROM ev GROUP BY 1 ORDER BY 1")
    assert a == b and len(a) == 15
    c = run("SELECT user_id, rate(rollup(c)) FROM (SELECT user_id, time_bucket('1 day', ts) AS d, counter_agg(ts, value) AS c FROM ev GROUP BY 1, 2) x GROUP BY user_id ORDER BY user_id")
    assert all(math.isclose(x[1], y[1]) for x, y in zip(a, c))


def test_one_name_for_all_kinds(run):
    text = """WITH s AS (SELECT event_type, stats_agg(value) AS s, time_weight('LOCF', ts, value) AS w, gauge_agg(ts, value) AS g, percentile_agg(value) AS p, tdigest(100, value) AS t, hyperloglog(64, user_id) AS h
      FROM ev WHERE value > 1 GROUP BY event_type)
      SELECT event_type, average(s), average(w), delta(g), mean(p), mean(t), distinct_count(h), s -> stddev('pop') AS sd, round(approx_percentile(0.5, p), 3) AS med, p -> approx_percentile(0.5) AS med2, integral(w, 'hour') > 0 AS up
      FROM s ORDER BY 1"""
    rows = run(text)
    exact = run("SELECT event_type, avg(value), stddev_pop(value), count(DISTINCT user_id), percentile(value, 0.5) FROM ev WHERE value > 1 GROUP BY event_type ORDER BY 1")
    for x, y in zip(rows, exact):
        assert x[0] == y[0] and math.isclose(x[1], y[1]) and math.isclose(x[4], y[1], rel_tol=0.01) and math.isclose(x[5], y[1]) and math.isclose(x[7], y[2])
        assert abs(x[6] - y[3]) <= 6 and math.isclose(x[8], y[4], rel_tol=0.05) and math.isclose(x[8], x[9], abs_tol=0.001) and x[10] is True


def test_neighbouring_buckets(run):
    text = """WITH b AS (SELECT user_id, time_bucket('1 week', ts) AS bucket, time_weight('linear', ts, value) AS twa, counter_agg(ts, value, time_bucket_range('1 week', ts)) AS c FROM ev GROUP BY 1, 2)
      SELECT user_id, bucket, interpolated_average(twa, bucket, '1 week', LAG(twa) OVER (PARTITION BY user_id ORDER BY bucket), LEAD(twa) OVER (PARTITION BY user_id ORDER BY bucket)) AS a,
        extrapolated_delta(c, 'prometheus') AS e FROM b ORDER BY 1, 2"""
    rows = run(text)
    assert len(rows) > 50 and all(r[2] is not None for r in rows)


def test_rows_from_summaries(run):
    states = run("SELECT user_id, state_timeline(state_agg(ts, event_type)) FROM ev GROUP BY user_id")
    assert len(states[0]) == 4 and len(states) > 500
    top = run("SELECT topn(mcv_agg(3, event_type)) FROM ev")
    assert len(top) == 3
    best = run("SELECT into_values(max_n(value, 4)) AS v FROM ev")
    assert best == run("SELECT value FROM ev ORDER BY value DESC LIMIT 4")
    freq = run("SELECT into_values(freq_agg(0.05, event_type)) FROM ev")
    assert len(freq) == 5 and math.isclose(sum(f[2] for f in freq), 1.0)
    beats = run("SELECT uptime(heartbeat_agg(ts, CAST(date_trunc('day', ts) AS timestamp), '1 day', '1 hour')) / 1e6 AS s FROM ev GROUP BY date_trunc('day', ts)")
    assert len(beats) == len(run("SELECT DISTINCT date_trunc('day', ts) FROM ev")) and all(0 < b[0] <= 86400 for b in beats)


def test_pipelines(run):
    a = run("SELECT user_id, timevector(ts, value) -> sort() -> delta() -> abs() -> sum() AS s FROM ev GROUP BY user_id ORDER BY 1")
    b = run("SELECT user_id, timevector(ts, value) -> (sort() -> delta() -> abs()) -> sum() AS s FROM ev GROUP BY user_id ORDER BY 1")
    want = run("SELECT user_id, sum(abs(value - p)) FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM ev) GROUP BY user_id ORDER BY 1")
    assert all(math.isclose(x[1], z[1]) and x == y for x, y, z in zip(a, b, want))
    points = run("SELECT unnest(lttb(ts, value, 10)) FROM ev")
    assert len(points) == 10 and len(points[0]) == 2
    kept = run("SELECT timevector(ts, value) -> filter('$value > 50') -> num_vals() AS n FROM ev")
    assert kept == run("SELECT count(*) FROM ev WHERE value > 50")


def test_rolling_and_plain_functions(run):
    got = run("""SELECT d, average(rolling(s) OVER (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS a FROM (SELECT time_bucket('1 day', ts) AS d, stats_agg(value) AS s FROM ev GROUP BY 1) ORDER BY d""")
    want = run("SELECT d, sum(t) OVER w / sum(n) OVER w FROM (SELECT date_trunc('day', ts) AS d, sum(value) AS t, count(*) AS n FROM ev GROUP BY 1) WINDOW w AS (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ORDER BY d")
    assert len(got) > 20 and all(x[0] == y[0] and math.isclose(x[1], y[1]) for x, y in zip(got, want))
    assert run("SELECT saturating_add(2147483647, 1) AS x, to_epoch(timestamp '2021-01-01 00:00:00') AS e, days_in_month(timestamp '2021-02-01') AS d") == [(2147483647, 1609459200.0, 28)]
    assert run("SELECT f64_lambda('$value ^ 2', ts, value) AS x FROM ev WHERE event_id = 1") == run("SELECT value * value FROM ev WHERE event_id = 1")


def test_generated_series(run):
    got = run("SELECT num_vals(stats_agg(value)) AS n, average(stats_agg(value)) > 900 AS near FROM generate_periodic_normal_series('2020-01-01', 7)")
    assert got == [(28 * 144, True)] and run("SELECT saturating_mul(100000, 100000) AS x") == [(2147483647,)]


def test_summaries_keep_their_kind_in_files(spark, run, tmp_path):
    frame = sql(spark, "SELECT user_id, state_agg(ts, event_type) AS s, candlestick_agg(ts, value, 1.0) AS c FROM ev GROUP BY user_id")
    frame.write.parquet(str(tmp_path / "kept"))
    spark.read.parquet(str(tmp_path / "kept")).createOrReplaceTempView("kept")
    rows = run("SELECT user_id, duration_in(s, 'click') AS d, high(c) AS h, close_time(c) AS t FROM kept ORDER BY 1")
    want = run("SELECT user_id, max(value), max(ts) FROM ev GROUP BY user_id ORDER BY 1")
    assert [(r[0], r[2], r[3]) for r in rows] == want


def test_errors(run):
    with pytest.raises(SqlError, match="no accessor"):
        run("SELECT rate(stats_agg(value)) -> nothing() AS x FROM ev")
    with pytest.raises(SqlError, match="no accessor"):
        run("SELECT open(s) AS x FROM (SELECT stats_agg(value) AS s FROM ev) t")
