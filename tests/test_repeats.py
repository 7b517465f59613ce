"""Queries against their SQL where many rows have one time."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import FOLDER, same
from tsmill.functions import metrics as M
from tsmill.operators import series as S
from tsmill.plans import registry


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Every event three times, with ids of its own and one time."""
    path = str(tmp_path_factory.mktemp("copies"))
    e = spark.read.parquet(f"{FOLDER}/events.parquet").where("event_id % 4 = 0").crossJoin(spark.range(3).select(F.col("id").alias("i")))
    e = e.withColumn("event_id", F.col("event_id") + F.col("i") * 10_000).drop("i")
    e.coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def rows(spark, path, name):
    got = registry.QUERIES[name](spark, path)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    want = duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    key = lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r]
    a = sorted(([r[c] for c in columns] for r in got.collect()), key=key)
    b = sorted(([r[i] for i in at] for r in want.fetchall()), key=key)
    assert len(a) == len(b) > 0
    bad = [(x, y) for x, y in zip(a, b) if not all(map(same, x, y))]
    assert not bad, (columns, len(bad), bad[:2])


@pytest.mark.parametrize("name", ["counter_by_type_in_slices", "counter_by_user", "counter_rollup_daily", "counter_ends", "counter_interpolated", "tv_counter", "tv_delta", "fill_linear"])
def test_rows_of_equal_times(spark, copies, name):
    rows(spark, copies, name)


@pytest.mark.parametrize("name", ["gauge_rollup_daily", "gauge_by_user", "gauge_interpolated"])
def test_gauges_of_equal_times(spark, copies, name):
    rows(spark, copies, name)


def test_without_repeats_one_row_stands_for_a_time(spark):
    df = spark.createDataFrame([("2024-01-01", 3.0), ("2024-01-01", 1.0), ("2024-01-02", 5.0)], "ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    for repeats, n, second in ((False, 2, 5.0), (True, 3, 3.0)):
        for s in (S.counter_agg(df, [], "ts", "v", repeats=repeats), df.agg(M.counter_agg("ts", "v", repeats=repeats).alias("summary"))):
            got = s.select(M.num_elements("summary").alias("n"), "summary.second.val", M.irate_left("summary").alias("rate"), M.delta("summary").alias("delta")).first()
            assert got == (n, second, 4 / 86400 if not repeats else float("inf"), 4.0)
