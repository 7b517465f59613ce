import hashlib
import random

import corpus_pipeline as P
from tests.llm.test_simhash import groups, plain
from tests.llm.test_spans import plain as without_repeats

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(7)
    vocab = {k: ["".join(r.choice(a) for _ in range(r.randint(2, 8))) for _ in range(400)] for k, a in {"en": "abcdefgh", "de": "lmnopqrst"}.items()}
    say = lambda k, n: " ".join(r.choice(vocab[k]) for _ in range(n)) + "."
    shared = say("en", 70)
    rows = []
    for i in range(120):
        k = "en" if i % 3 else "de"
        t = say(k, 150)
        if i % 10 == 0:
            t = say(k, 60) + " " + shared + " " + say(k, 60)
        rows.append((i, t, k, f"s{i % 5}"))
    rows += [(200 + i, rows[i][1], rows[i][2], "s1") for i in range(6)]
    rows += [(300, None, "en", "s1"), (301, "", None, None), (302, "12 34 !!", "en", "s2"), (303, rows[1][1] + " extra", "en", None)]
    return [(d, t, k, s, len(t) if t is not None else None) for d, t, k, s in rows]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    path = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    states = []
    for _, stage in P.STAGES:
        docs = P.cut(stage(spark, docs, path), "t")
        states.append(docs)
        if stage is not P.encoding:
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    # language: what holds no letter goes
    kept = [x for x in rows if x[1] and any(map(str.isalpha, x[1]))]
    assert sorted(map(tuple, states[0].collect()), key=lambda x: x[0]) == kept
    # near copies: the smallest id of each group stays
    part = groups([plain(x[1], 5) for x in kept])
    kept = [x for i, x in enumerate(kept) if part[i] == i]
    assert sorted(x.doc_id for x in states[1].collect()) == [x[0] for x in kept] and len(kept) <= 120
    # passages
    clean = without_repeats([(x[0], x[1]) for x in kept])
    assert sorted((x.doc_id, x.text) for x in states[2].collect()) == sorted((d, t) for (d, _), t in clean.items() if t.strip())
    assert all(x.n_chars == len(x.text) for x in states[2].collect())
    # the mix takes whole documents, near its targets, each twice at most
    before = {x.doc_id: (x.text, x.source) for x in states[2].collect()}
    after = [x for x in states[3].collect()]
    size = lambda t: len(t.split())
    assert all(before[x.doc_id] == (x.text, x.source) for x in after)
    n = [sum(y.doc_id == x for y in after) for x in before]
    assert max(n) == 2 and min(n) == 0
    total = sum(size(t) for t, _ in before.values())
    assert abs(sum(size(x.text) for x in after) - 1.5 * total) < 0.2 * total
    # tokens
    from tsmill.llm import bpe

    lib = bpe.load(bpe.default_path()).library
    want = []
    for x in after:
        ids = lib.encode(x.text, add_special_tokens=False).ids
        want.append((x.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert sorted((x.doc_id, x.n_tokens, x.ids_sha256) for x in states[4].collect()) == sorted(want)
    again = P.run(spark, path)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, states[4].collect()))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
