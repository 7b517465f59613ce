"""The SimHash step of the near copies."""

import random

from pyspark.sql import functions as F

from tsmill.llm import nearcopies as N
from tsmill.llm.simhash import fingerprint


def corpus():
    r = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(25):
        base = r.choices(words, k=400)
        for edits in (0, 1, 2, 30):
            t = list(base)
            for _ in range(edits):
                t[r.randrange(400)] = r.choice(words)
            texts.append(" ".join(t))
    return [*texts, "", "Two words"]


def groups(nodes, pairs):
    of = {n: n for n in nodes}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_pairs_connect_what_three_bits_connect(spark):
    texts = corpus()
    fp = [fingerprint(t.encode(), 5) for t in texts]
    assert [N.bands(t)[2] for t in texts] == fp and N.bands(None)[2] == 0
    signed = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fp)]
    got = N.fingerprint_pairs(spark.createDataFrame(signed, "th long, fp long")).collect()
    want = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    assert want and groups(range(len(fp)), [(r.a, r.b) for r in got]) == groups(range(len(fp)), want)


def test_near_copies_go_through_fingerprints(spark, monkeypatch):
    """Groups are those of the shingles, and every pair the fingerprints give is a candidate."""
    seen = []
    real = N.fingerprint_pairs
    monkeypatch.setattr(N, "fingerprint_pairs", lambda p: (seen.append(real(p).count()), real(p))[1])
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, parts = N.near_copies(docs)
    assert seen and seen[0] > 0
    named = rows.join(parts.withColumnRenamed("node", "th"), "th", "left").select("doc_id", F.coalesce("component", "th").alias("c")).collect()
    sets = [N.shingles(t) for t in texts]
    want = groups(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if N.similar(sets[i], sets[j])])
    least = {}
    for r in named:
        least[r.c] = min(least.get(r.c, r.doc_id), r.doc_id)
    assert {r.doc_id: least[r.c] for r in named} == want
