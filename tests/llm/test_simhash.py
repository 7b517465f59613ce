import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tsmill.llm import simhash as S
from tsmill.llm.common import connected_components


def plain(text, width=3):
    if text is None:
        return 0
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_the_definition():
    r = random.Random(1)
    for text in [None, "", " \t\n", "One", "one  TWO", "a b c d", "É é ß A B c", *(" ".join(r.choice("abcdefg") for _ in range(n)) for n in (3, 9, 400))]:
        for width in (3, 5):
            assert S.fingerprint(None if text is None else text.encode(), width) == plain(text, width)


def test_words_within_two_bits_share_a_key():
    r = np.random.default_rng(2)
    x = r.integers(0, 1 << 23, 3000)
    for bits in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in r.choice(23, bits, replace=False):
                y[i] ^= 1 << int(b)
        for a, b in zip(S.segment_keys(x), S.segment_keys(y)):
            assert set(a[a >= 0]) & set(b[b >= 0])


def test_fingerprints_within_three_bits_share_a_key():
    r = random.Random(3)
    x = [r.getrandbits(64) for _ in range(1500)]
    y = [a ^ sum(1 << b for b in r.sample(range(64), 3)) for a in x]
    held = []
    for z in (x, y):
        row, key = S.keys(np.array(z, np.uint64).view(np.int64))
        held.append([set() for _ in z])
        for i, k in zip(row, key):
            held[-1][i].add(int(k))
    assert all(a & b for a, b in zip(*held))


def test_bucket_links_agree_both_ways():
    r = random.Random(4)
    fps = set()
    for _ in range(12):
        c = r.getrandbits(64)
        for _ in range(12):
            fps.add(c)
            c ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
    fps = sorted(fps)
    want = groups(fps)
    for compare in (10_000, 0):
        f = S.Forest(len(fps))
        for i, j in S.bucket_links(np.array(fps, np.uint64).view(np.int64), compare):
            assert bin(fps[i] ^ fps[j]).count("1") <= 3 or compare == 0
            f.union(i, j)
        assert [f.find(i) for i in range(len(fps))] == want


def test_components_on_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(900, None), (901, ""), (902, "  "), (903, "x"), (904, "x"), (903, "x"), (None, "x")]
    for g in range(8):
        base = [r.choice(words) for _ in range(220)]
        for k in range(12):
            rows.append((g * 20 + k, " ".join(base)))
            base[r.randrange(220)] = r.choice(words)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component", F.lit("clash"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect())
    fps = [plain(t) for _, t in rows]
    part = groups(fps)
    least = {p: min((d for (d, _), q in zip(rows, part) if q == p and d is not None)) for p in part}
    want = sorted((d is None, d or 0, f"{f:016x}", least[p]) for (d, _), f, p in zip(rows, fps, part))
    assert got == want
    kept = sorted(x.doc_id for x in S.keep_one(df, 3).where("doc_id is not null").collect())
    assert kept == sorted({w[3] for w in want})


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_narrow_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id int, text string")
    assert {x.component_id for x in S.near_duplicates(df).collect()} == {1}
