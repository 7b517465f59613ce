import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tsmill.llm import lm as L


def words(t):
    return [*("" if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)).encode().split(), b"<end>"]


def crc(d):
    return zlib.crc32(b"" if d is None else str(d).encode())


def plain(rows, alpha):
    """Base score, and the score with exact levels."""
    uni, bi, docs = Counter(), Counter(), 0
    for d, t in rows:
        if crc(d) % 10:
            w = words(t)
            uni.update(w)
            bi.update(zip([None, *w], w))
            docs += 1
    n, v = sum(uni.values()), len(uni)
    den = n + 0.1 * (v + 1)
    lo = lambda c: 2.0 ** int(math.log2(c)) if c else 0.0
    hi = lambda c: 2.0 * lo(c) - 1 if c else 0.0
    out = []
    for d, t in rows:
        w = words(t)
        base = sum(math.log10((uni[x] + 0.1) / den) for x in w)
        s = 0.0
        for a, b in zip([None, *w], w):
            s += math.log10((lo(bi[a, b]) + alpha * (lo(uni[b]) + 0.1) / den) / ((docs if a is None else hi(uni[a])) + alpha))
        out.append((d, crc(d) % 10 == 0, len(w), sum(uni[x] > 0 for x in w), n, base, s))
    return out


def corpus():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["É", "THE", "the"]
    rows = [(i, " ".join(r.choice(vocab[: 5 + i % 55]) for _ in range(r.randint(0, 40)))) for i in range(300)]
    rows += [(None, None), (None, "a b"), (7, ""), (7, ""), (8, rows[8][1]), (9, " \t"), (600, "only here once"), (10, "z " * 20000)]
    return rows


def check(got, want, tolerance):
    key = lambda x: (x[0] is None, x[0] or 0, x[2], round(x[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9)
    # a false positive raises one probability; few texts have one
    assert np.mean([not math.isclose(g[6], w[6], rel_tol=1e-9) for g, w in zip(got, want)]) <= tolerance
    assert np.mean([abs(g[6] / w[6] - 1) for g, w in zip(got, want)]) <= tolerance / 20 + 1e-12


def test_both_ways_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("h", F.lit(1)).repartition(3)
    want = plain(rows, L.ALPHA)
    gathered, travelling = L.score_documents(df).collect(), L.score_documents(df, most_mb=0).collect()
    check(gathered, want, 0.2)
    key = lambda x: str((x.doc_id, x.n_tokens, round(x.base_score, 6), round(x.score, 9)))
    assert sorted(map(key, gathered)) == sorted(map(key, travelling))


def test_filter_never_forgets_and_seldom_invents():
    r = np.random.default_rng(1)
    h = np.unique(r.integers(0, 1 << L.KEY_BITS, 60_000).astype(np.uint64))
    c = r.integers(1, 400, len(h))
    seg = L._segment(h, 3)
    f = L.LogFrequencyFilter([L.make_segment(h[seg == s], c[seg == s]).tobytes() for s in range(3)])
    q = f.level(h)
    assert (q >= L.level(c)).all() and (q == L.level(c)).mean() > 0.98
    other = r.integers(0, 1 << L.KEY_BITS, 60_000).astype(np.uint64)
    assert (f.level(other) > 0).mean() < 0.03
    assert L.low(L.level(np.array([0, 1, 2, 3, 4, 7, 8]))).tolist() == [0, 1, 2, 2, 4, 4, 8]


def test_pairs_of_large_counts():
    h = np.arange(5, dtype=np.uint64)
    n = np.array([1, 254, 255, 256, 70_000], np.uint32)
    packed = np.where(n < 255, n, 255).astype(np.uint8).tobytes() + n[n >= 255].tobytes()
    assert L._unpack(L.pack(h), packed)[1].tolist() == n.tolist()
    for keys in ([], [0], [0, 1, 1 << 40, (1 << 48) - 1], sorted(random.Random(1).sample(range(1 << 48), 500))):
        assert L.unpack(L.pack(np.array(keys, np.uint64))).tolist() == keys


def test_many_segments_and_groups(spark, monkeypatch):
    monkeypatch.setattr(L, "PART", 1000)
    monkeypatch.setattr(L, "SCORED", 700)
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    a, b = L.score_documents(df).collect(), L.score_documents(df, most_mb=0).collect()
    key = lambda x: str((x.doc_id, x.n_tokens, round(x.base_score, 6), round(x.score, 9)))
    assert len(a) == len(corpus()) and sorted(map(key, a)) == sorted(map(key, b))


def test_empty_table(spark):
    assert L.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_held_out_texts_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = L.score_documents(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.max("score")).first()
    assert r[0] > r[1] and r[2] < 0


def test_counts_beyond_32_bits():
    import numpy as np
    import pyarrow as pa

    from tsmill.llm import lm

    counts = lm.Counts.__new__(lm.Counts)
    counts.segments = 1
    n = np.array([5_000_000_000, 3, 70_000], np.int64)
    (blob,) = counts._word_blobs()(iter([pa.record_batch([pa.array([1, 2, 3]), pa.array(n)], names=["h", "n"])]))
    _, c = lm._unpack(blob.column(1)[0].as_py(), blob.column(2)[0].as_py())
    assert sorted(c.tolist()) == sorted(n.tolist()) and lm.level(c).max() == 33
