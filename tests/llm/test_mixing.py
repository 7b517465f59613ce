import random

from pyspark.sql import functions as F

from tsmill.llm import mixing as M

W = (3.0, 1.0, 2.0)


def plain_targets(rows):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: W[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in capped)
        left = total - sum(2 * size[s] for s in capped)
        t = {s: 2.0 * size[s] if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and t[s] > 2 * size[s] + 1e-9}
        if not over:
            return size, t
        capped |= over


def rows_of(n, seed=1):
    r = random.Random(seed)
    out = [(None, "a b", "s1"), (5, None, "s2"), (5, None, "s2"), (6, "  ", None), (7, "x y z", None), (7, "x y z", None)]
    for i in range(n):
        out.append((100 + i, " ".join("w" for _ in range(r.randint(1, 60))), r.choice(["s1", "s1", "s1", "s2", "s3", "ß", None])))
    out.append((99999, "big " * 3000, "s9"))
    return out


def test_targets_sizes_and_taken(spark):
    rows = rows_of(400)
    size, target = plain_targets(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("block", F.lit(1))
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    taken = {}
    for g in got:
        assert g["source_size"] == size[g["source"]] and abs(g["target"] - target[g["source"]]) < 1e-6
        assert 0 <= g["taken"] <= 2 * g["size"]
        taken[g["source"]] = taken.get(g["source"], 0) + g["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.5, s
    again = M.mix(df.repartition(7)).collect()
    key = lambda x: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in x)
    assert key(got) == key(again)


def test_mixed_documents_repeat_whole_rows(spark):
    df = spark.createDataFrame(rows_of(200, 2), "doc_id long, text string, source string")
    plan = M.mix(df).where("size > 0").select("doc_id", F.floor(F.col("taken") / F.col("size") + 0.5).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))
    want = {r.doc_id: r.n for r in plan.collect() if r.n}
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == want


def test_nothing_to_mix(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(empty).collect() == []
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.taken, r.target) for r in M.mix(blank).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}


def test_every_source_meets_its_target(spark):
    # large sources beside small ones, and many sources of one short document: none falls short by more than rounding
    large = [(i, "w " * 40_000, f"big{i % 4}") for i in range(40)]
    small = [(1000 + i, "w " * (7 + i), f"small{i}") for i in range(30)]
    many = [(5000 + i, "a b c d e f g h", f"m{i}") for i in range(3000)]
    for rows in (large + small, many):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        got = M.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
        assert all(abs(g["taken"] - g["target"]) <= 0.5 for g in got)
        _, target = plain_targets(rows)
        assert all(abs(g["target"] - target[g["source"]]) < 1e-6 for g in got)


def test_schedule_is_even_and_blocks_are_equal(spark):
    """Slots follow the golden-ratio points; each stretch holds the sources in proportion; blocks differ by a word."""
    shares = {0: 700_000, 1: 250_000, 2: 49_990, 3: 10, 4: 0}
    by = spark.createDataFrame(list(shares.items()), "sid int, quota long")
    rows = sorted((x.slot, x.sid, x.r) for x in M.schedule(by, 10_000).collect())
    points = [(i + 1) * M.STEP % 1 for i in range(10_000)]
    edge = [0.7, 0.95, 0.99999, 1.0]
    want = [next(k for k, e in enumerate(edge) if u < e) for u in points]
    assert [sid for slot, sid, _ in rows if slot < 10_000] == want
    assert [(slot, sid) for slot, sid, _ in rows if slot >= 10_000] == ([] if 3 in want else [(10_003, 3)])
    for lo in range(0, 10_000, 500):
        assert abs(want[lo : lo + 500].count(1) - 125) <= 6
    for s in range(4):
        assert [r for _, sid, r in rows if sid == s] == list(range(sum(sid == s for _, sid, _ in rows)))


def test_slots_hold_equal_blocks(spark):
    rows = [(i, "w " * 10, f"s{i % 2}") for i in range(4000)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all((g.slot is None) == (g.taken == 0) for g in got)
    # a document of the first pass is taken by an early slot or the like: slots rise along the line
    for s in ("s0", "s1"):
        line = [g.slot for g in sorted((g for g in got if g.source == s and g.slot is not None), key=lambda g: (g.h, g.doc_id))]
        assert line == sorted(line)


def test_copies_go_to_their_own_rows(spark):
    """Equal id and text under two sources, and rows that differ in another column only."""
    rows = [(i, f"a{i} b c d", s, n) for i in range(200) for s, n in (("a", 1), ("b", 1))] + [(5000, "only words", "c", n) for n in range(40)]
    rows += [(9000 + i, "x " * 400, "b", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, k1 long")
    plan = {}
    for g in M.mix(df).collect():
        plan[g.source] = plan.get(g.source, 0) + int(g.taken / g["size"] + 0.5)
    got = {x.source: x["count"] for x in M.mixed_documents(df).groupBy("source").count().collect()}
    assert got == {s: n for s, n in plan.items() if n}
    once = M.mixed_documents(df).groupBy(*df.columns).count()
    assert once.where("count > 2").count() == 0


def test_against_sql(spark):
    import duckdb
    import pyarrow as pa

    rows = rows_of(400, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([{"doc_id": d, "text": t, "source": s} for d, t, s in rows]))
    want = con.execute(M.SQL).fetchall()
    got = M.mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
