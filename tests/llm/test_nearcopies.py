import random

import pytest

from tsmill.llm import nearcopies as N


def plain(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(seed, n):
    """Pairs of 230 words with 1 to 11 of them replaced."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(n):
        base = [r.choice(words) for _ in range(230)]
        other = list(base)
        for at in r.sample(range(230), 1 + g % 11):
            other[at] = r.choice(words)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    return rows


def test_recall_by_band_of_similarity(spark):
    rows = edited(1, 330)
    sets = [plain(t) for _, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id for x in N.keep_least(docs).collect()}
    by_band = {}
    for g in range(330):
        s = jaccard(sets[2 * g], sets[2 * g + 1])
        assert 2 * g in kept
        band = by_band.setdefault(int(s * 20) / 20 if s >= 0.8 else 0, [0, 0])
        band[0] += 1
        band[1] += 2 * g + 1 not in kept
    assert all(n == found for s, (n, found) in by_band.items() if s) and len(by_band) >= 5
    assert by_band[0][0] > 20 and by_band[0][1] == 0  # below 0.8 both stay


@pytest.mark.parametrize("block", [512, 3])
def test_chains_against_brute_force(spark, monkeypatch, block):
    """With blocks of 3 texts, most bands are compared in several cells."""
    monkeypatch.setattr(N, "BLOCK", block)
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(900, None), (901, ""), (902, "  "), (903, "x"), (904, "X"), (None, "x"), (905, "a b c d e"), (906, "a b c d e f")]
    for g in range(6):
        base = [r.choice(words) for _ in range(80)]
        for k in range(12):
            rows.append((g * 20 + k, " ".join(base)))
            for _ in range(1 + k % 4):
                base[r.randrange(80)] = r.choice(words)
    named = [x for x in rows if x[0] is not None]
    sets, part = [plain(t) for _, t in named], list(range(len(named)))
    for i in range(len(named)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and part[i] != part[j]:
                part = [part[j] if p == part[i] else p for p in part]
    want = {min(named[i][0] for i in range(len(named)) if part[i] == p) for p in set(part)}
    got = [x.doc_id for x in N.keep_least(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 1


def test_one_id_on_rows_that_differ(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, a, "s1"), (1, b, "s2"), (1, a, "s3"), (1, a + " ", "s4"), (2, b, "s5"), (3, a, "s0")]
    outcomes = set()
    for k in range(4):
        random.Random(k).shuffle(rows)
        got = N.keep_least(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(1 + k)).collect()
        assert sorted((x.doc_id, x.text.strip()) for x in got) == sorted([(1, a), (1, b)])
        outcomes.add(tuple(sorted((x.doc_id, x.text, x.source) for x in got)))
    assert len(outcomes) == 1


def test_large_groups_send_on_few_rows(spark, monkeypatch):
    """300 copies that are alike to their base only, and 300 texts that share a half: no turn sends on their pairs."""
    r = random.Random(6)
    say = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    base, half, rows = say(200), say(100), []
    for k in range(300):
        w = list(base)
        for at in r.sample(range(200), 4):
            w[at] = "x" + str(r.randrange(10**6))
        rows += [(2 * k + 1, " ".join(w)), (2 * k + 2, " ".join(half + say(100)))]
    rows.append((1001, " ".join(base)))
    sent = {}
    plain_cut = N.cut
    monkeypatch.setattr(N, "cut", lambda df, name: sent.setdefault(name, []).append(out := plain_cut(df, name)) or out)
    monkeypatch.setattr(N, "drop_cut", lambda df: None)
    _, parts = N.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert parts.groupBy("component").count().collect()[0]["count"] == 300 and parts.select("component").distinct().count() == 1
    assert all(df.count() < 40 * len(rows) for dfs in sent.values() for df in dfs)
