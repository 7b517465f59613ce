import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tsmill.operators import sketches as K


def first(df):
    return df.first()[0]


@pytest.fixture(scope="module")
def hourly(spark):
    return spark.range(10001).select((F.lit(100.0) + F.col("id") % 100).alias("val"), (F.col("id") % 3).alias("k"))


def test_uddsketch_of_a_long_series(hourly):
    s = K.uddsketch(hourly, [], "val", 100, 0.001)
    assert math.isclose(first(s.select(K.udd_percentile("sketch", 0.1))), 108.96220333142547, rel_tol=1e-12)
    parts = K.uddsketch(hourly, ["k"], "val", 100, 0.001)
    assert parts.count() == 3
    merged = K.rollup_uddsketch(parts, [], "sketch", 100, 0.001)
    a, b = first(s), first(merged)
    assert a.buckets == b.buckets and a.compactions == b.compactions and math.isclose(a.sum, b.sum)
    assert s.select(K.num_vals("sketch")).first()[0] == 10001 and math.isclose(s.select(K.mean("sketch")).first()[0], 149.5, rel_tol=1e-3)


def plain_udd(values, size, error):
    gamma, alpha, buckets, c = (1 + error) / (1 - error), error, {}, 0
    for v in values:
        k = (0, 0) if v == 0 else ((1 if v > 0 else -1), math.ceil(math.log(abs(v)) / math.log((1 + error) / (1 - error))))
        for _ in range(c):
            k = (k[0], math.ceil(k[1] / 2))
        buckets[k] = buckets.get(k, 0) + 1
        while len(buckets) > size:
            new = {}
            for (s, i), n in buckets.items():
                new[s, math.ceil(i / 2)] = new.get((s, math.ceil(i / 2)), 0) + n
            buckets, c, gamma, alpha = new, c + 1, gamma * gamma, 2 * alpha / (1 + alpha * alpha)
    return buckets, c, alpha


def test_uddsketch_states_and_error_bound(spark):
    r = random.Random(1)
    for size, error in ((20, 0.01), (64, 0.05), (200, 0.001)):
        v = [r.choice([0.0, r.gauss(0, 100), -r.paretovariate(1), r.lognormvariate(0, 5)]) for _ in range(1500)]
        df = spark.createDataFrame([(x,) for x in v], "v double")
        s = first(K.uddsketch(df, [], "v", size, error))
        buckets, c, alpha = plain_udd(v, size, error)
        assert {(b.sign, b.idx): b.n for b in s.buckets} == buckets and s.compactions == c and math.isclose(s.alpha, alpha)
        v.sort()
        frame = K.uddsketch(df, [], "v", size, error)
        for p in (0.0, 0.2, 0.5, 0.9, 1.0):
            got = first(frame.select(K.udd_percentile("sketch", p)))
            want = v[min(len(v) - 1, int(len(v) * p))]
            assert abs(got - want) <= alpha * abs(want) * (1 + 1e-9) + 1e-12
        rank = first(frame.select(K.udd_percentile_rank("sketch", v[700])))
        assert abs(rank - 700 / 1500) < 0.35


def test_tdigest(spark, hourly):
    s = K.tdigest(hourly, [], "val", 100)
    got = s.select(K.tdigest_percentile("sketch", 0.1), K.tdigest_percentile("sketch", 0.9), K.tdigest_percentile_rank("sketch", 150.0), K.min_val("sketch"), K.max_val("sketch"), K.num_vals("sketch")).first()
    assert abs(got[0] - 109.5) < 0.5 and abs(got[1] - 189.5) < 0.5 and abs(got[2] - 0.505) < 0.01 and got[3:] == (100.0, 199.0, 10001)
    split = K.tdigest(hourly, ["k"], "val", 100, part_rows=500)
    both = K.rollup_tdigest(split, [], "sketch", 100).select(K.tdigest_percentile("sketch", 0.5), K.num_vals("sketch"), K.total("sketch")).first()
    assert abs(both[0] - 149.5) < 1 and both[1] == 10001 and math.isclose(both[2], first(hourly.agg(F.sum("val"))))
    odd = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "val double")
    assert K.tdigest(odd, [], "val", 10).select(K.num_vals("sketch"), K.tdigest_percentile("sketch", 1.0)).first() == (2, 3.0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=400), st.integers(5, 60))
def test_clusters_keep_weight_and_order(values, size):
    x = np.sort(np.array(values))
    m, w = K.cluster(x, np.ones(len(x), np.int64), size)
    assert w.sum() == len(x) and len(m) <= 2 * size + 1 and (np.diff(m) >= -1e-6).all() and math.isclose((m * w).sum(), x.sum(), rel_tol=1e-6, abs_tol=1e-3)


def test_hyperloglog(spark):
    for n in (0, 1, 150, 5000, 100_000):
        df = spark.range(n).select(F.concat(F.lit("x"), F.col("id")).alias("v"), (F.col("id") % 4).alias("k"))
        s = K.hyperloglog(df, [], "v", 1000)
        got = s.select(K.distinct_count("sketch"), K.stderror("sketch")).first()
        assert math.isclose(got[1], 1.04 / 32) and abs(got[0] - n) <= max(1, 4 * got[1] * n)
        if n == 5000:
            merged = K.rollup_hyperloglog(K.hyperloglog(df, ["k"], "v", 1000), [], "sketch")
            assert first(merged) == first(s)
    with pytest.raises(ValueError):
        K.hyperloglog(df, [], "v", 1 << 19)


def test_frequencies(spark):
    df = spark.range(5050).select(F.floor((F.sqrt(F.col("id") * 8 + 1) - 1) / 2).alias("v"), (F.col("id") % 2).alias("k"))  # i occurs i + 1 times
    s = K.freq_agg(df, [], "v", 0.015)
    assert [r[0] for r in s.select(K.topn("sketch")).collect()] == list(range(99, 74, -1))
    r = s.select(K.max_frequency("sketch", 99), K.min_frequency("sketch", 98), K.max_frequency("sketch", 3)).first()
    assert math.isclose(r[0], 100 / 5050) and math.isclose(r[1], 99 / 5050) and r[2] == 0.0
    assert len(first(s).entries) == 67 and len(s.select(K.freq_into_values("sketch")).collect()) == 67
    merged = K.rollup_freq(K.freq_agg(df, ["k"], "v", 0.015), [], "sketch")
    for e in first(merged).entries[:30]:
        assert e["count"] - e.overcount <= e.value + 1 <= e["count"]
    skewed = spark.range(4000).select(F.floor(F.lit(40.0) / (F.col("id") % 40 + 1)).cast("string").alias("v"))
    m = K.mcv_agg(skewed, [], "v", 3)
    assert len(m.select(K.topn("sketch")).collect()) == 3
    with pytest.raises(Exception, match="fewer"):
        m.select(K.topn("sketch", 9)).collect()
    with pytest.raises(ValueError):
        K.mcv_agg(skewed, [], "v", 3, 1.0)
    assert math.isclose(K.zeta(2.0), math.pi**2 / 6, rel_tol=1e-12)


def test_count_min(spark):
    df = spark.range(150).select(F.when(F.col("id") < 100, F.col("id")).otherwise(F.col("id") - 100).cast("string").alias("v"))
    s = K.count_min_sketch(df, [], "v", 0.01, 0.01)
    got = [s.select(K.approx_count(x, "sketch")).first()[0] for x in ("1", "49", "50", "99", "none")]
    assert got[0] >= 2 and got[1] >= 2 and got[2] >= 1 and got[3] >= 1 and all(g <= 4 for g in got)
    deep = K.count_min_sketch(df, [], "v", 0.5, 1e-15)  # 35 rows of 6 cells: the least is taken over all of them
    cells = first(deep)
    want = min(cells.cells[c] for c in (spark.range(1).select(K._cell(F.lit("7"), i, cells.width)).first()[0] for i in range(cells.depth)))
    assert cells.depth == 35 and deep.select(K.approx_count("7", "sketch")).first()[0] == want


def test_sketches_that_differ_do_not_merge(spark):
    df = spark.range(1, 1000).select(F.col("id").cast("double").alias("v"))
    both = K.uddsketch(df, [], "v", 100, 0.01).unionByName(K.uddsketch(df, [], "v", 100, 0.05))
    with pytest.raises(Exception, match="cannot be merged"):
        K.rollup_uddsketch(both, [], "sketch", 100, 0.01).collect()


def test_digest_does_not_depend_on_the_order_of_rows(spark):
    df = spark.range(400_000).select((F.col("id") * 7919 % 300_007 / 7).alias("v"))
    one, two = (K.tdigest(x, [], "v", 100).select("sketch", K.tdigest_percentile("sketch", 0.5).alias("p")).first() for x in (df.repartition(3), df.orderBy("v").repartition(7)))
    assert one == two and one["sketch"]["count"] == 400_000
    assert abs(one["p"] - 300_007 / 14) < 300


def test_sums_out_of_range_are_an_error(spark):
    from tsmill.functions import stats

    df = spark.createDataFrame([(1e308,), (1e308,), (-1e308,)], "v double")
    with pytest.raises(Exception, match="22003"):
        df.agg(stats.stats_agg("v").alias("s")).collect()
    inf = spark.createDataFrame([(float("inf"),), (1.0,)], "v double")
    assert inf.agg(stats.stats_agg("v").alias("s")).first()["s"]["n"] == 2
