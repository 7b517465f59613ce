import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tsmill.llm import sharding as H
from tsmill.llm.common import new_folder

OPTIONS = {"least_bytes": 4000, "target_bytes": 60_000}


def corpus(n=3000):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 120)))) for i in range(n)]
    return rows + [(None, None), (None, "x"), (5, None), (7, rows[7][1]), (7, rows[7][1])]


def digests(rows):
    return sorted((str(d), None if t is None else hashlib.sha256(t.encode()).hexdigest()) for d, t in rows) if rows else []


def key(rows):
    return sorted(((str(d), s or "") for d, s in rows))


def test_rows_survive_and_files_grow(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"path": F.lit("clash"), "rows": F.lit(1)}).repartition(6)
    store, version = H.shard(df, rows=100, **OPTIONS)
    got = H.contents(store, version).collect()
    assert key((g.doc_id, g.text_sha256) for g in got) == key((d, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    m = store.manifest().collect()
    assert sum(e.rows for e in m) == len(rows) and version > 4
    full = [e for e in m if e.tier == 99]
    assert full and all(e.bytes <= 2 * OPTIONS["target_bytes"] for e in m)
    tiers = [e.tier for e in m if e.tier < 99]
    assert all(tiers.count(t) < H.FANOUT for t in tiers)
    assert {g.shard_rows for g in got} == {e.rows for e in m}
    # only live files are left
    assert sum(len([x for x in store._names(f"data/{d}") if x.endswith(".parquet")]) for d in store._names("data")) == len(m)
    assert store.read().columns == df.columns


def test_versions_are_exclusive_and_stay(spark):
    store = H.ShardStore(spark, new_folder(spark, "t"), **OPTIONS)
    assert store.version() == 0 and store.read() is None and store.compact() is None
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    assert store.append(df.where("doc_id < 500"), rows=50) == 1
    other = H.ShardStore(spark, store.folder, **OPTIONS)
    entries = other.manifest()
    assert store.append(df.where("doc_id >= 500"), rows=50) == 2
    with pytest.raises(H.Conflict):
        other.commit(entries, 1)
    assert store.version() == 2 and store.read().count() == 1000 and store.read(1).count() == 500
    before = {e.path for e in store.manifest().collect()}
    assert store.compact() == 3
    assert not before & {e.path for e in store.manifest().collect() if e.since == 3}
    assert store.read(2).count() == store.read().count() == 1000  # the old version reads until vacuum
    assert store.vacuum() >= len(before - {e.path for e in store.manifest().collect()})  # files without rows go too
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(1000))


def test_empty_table(spark):
    store, version = H.shard(spark.createDataFrame([], "doc_id long, text string"))
    assert H.contents(store, version).collect() == []


def test_writers_do_not_lose_shards(spark):
    """A writer that has written its shards and not yet committed them keeps them, whatever others vacuum and commit."""
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    store = H.ShardStore(spark, new_folder(spark, "t"), **OPTIONS)
    store.append(df.where("doc_id < 500"), rows=50)
    late = "data/late"
    df.where("doc_id >= 500").write.parquet(f"{store.folder}/{late}")
    store.append(df.where("doc_id < 10"), rows=50)
    store.compact_fully()
    store.vacuum()
    assert store.add(late) == store.version()
    assert sorted(r.doc_id for r in store.read().collect()) == sorted([*range(1000), *range(10)])


def test_of_two_writers_the_second_tries_again(spark, monkeypatch):
    df = spark.range(100).select(F.col("id").alias("doc_id"))
    store, other = (H.ShardStore(spark, f, **OPTIONS) for f in [new_folder(spark, "t")] * 2)
    plain, hurried = store.manifest, []

    def slow(version=None):
        if not hurried:
            hurried.append(1)
            other.append(df.where("doc_id < 50"))
        return plain(version)

    monkeypatch.setattr(store, "manifest", slow)
    assert store.append(df.where("doc_id >= 50")) == 2
    assert store.read().count() == 100


def test_versions_that_are_kept_read(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"))
    store = H.ShardStore(spark, new_folder(spark, "t"), **OPTIONS)
    for k in range(4):
        store.append(df.where(f"doc_id % 4 = {k}"), rows=20)
    store.compact_fully(keep=3)
    last = store.version()
    assert [store.read(v).count() for v in (last - 2, last - 1, last)] == [300, 400, 400]


def test_odd_columns_and_long_texts(spark):
    df = spark.createDataFrame([(1, "x" * 3_000_000, 5, "n"), (None, "", None, None), (None, None, 7, "m")], "doc_id long, text string, part int, name string")
    store, version = H.shard(df, **OPTIONS)
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert key(store.read().select(*df.columns).collect()) == key(df.collect())
    assert H.contents(store, version).count() == 3
