import hashlib
import random
import re

from pyspark.sql import functions as F

from tsmill.llm import imatch as I


def corpus(n=700):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(900)] + ["Éa", "the", "THE"]
    rows = [(3 * i, " ".join(vocab[min(len(vocab) - 1, int(r.paretovariate(0.4)))] for _ in range(r.randint(0, 90)))) for i in range(n)]
    rows += [(5, None), (5, None), (7, ""), (8, "!?"), (9, rows[4][1]), (None, "null id"), (None, "a b"), (10**15, "far away"), (11, "é" * 9001)]
    return rows


def test_edits_and_order(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cell", F.lit("clash")).withColumn("t", F.lit(1)).repartition(5)
    got = I.fingerprints(df).collect()
    assert len(got) == len(rows)
    h = lambda t: hashlib.md5(t.encode()).hexdigest()[:15]
    line = sorted(((d is None, d or 0, h(t or ""), t or "") for d, t in rows))
    want = []
    for (none, d, _, t), nxt in zip(line, line[1:] + line[:1]):
        k = len(t) // 2
        e = t[: len(t) - k] + nxt[3][:k]
        want.append((none, d, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted((g.doc_id is None, g.doc_id or 0, g.n_chars, g.edited_sha256) for g in got) == sorted(want)
    assert all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)
    by = {}
    for g in got:
        by.setdefault((g.doc_id is None, g.doc_id or 0, g.n_chars), []).append(g)
    assert by[False, 5, 0][0].fingerprint == by[False, 5, 0][1].fingerprint == by[False, 7, 0][0].fingerprint
    assert by[False, 9, len(rows[4][1])][0].fingerprint == by[False, 12, len(rows[4][1])][0].fingerprint
    # half of a text says more about it than another text does
    long = [g for g in got if g.n_chars > 150]
    assert sum(g.near_edited for g in long) > 3 * sum(g.near_next for g in long)


def components(text, lex):
    """The plain way: hashes of sorted distinct terms."""
    md5 = lambda x, n: hashlib.md5(x.encode()).hexdigest()[:n]
    terms = sorted(set(re.findall(r"[^\W_]+", text.lower())))
    held = [w for w in terms if w in lex]
    first = md5(" ".join(held) if held else " ".join(terms) if terms else text, I.FIRST)
    rest = []
    for family in range(I.EACH):
        for level in I.LEVELS:
            inside = [w for w in held if int(md5(w, 32)[8 * family :][:3], 16) < 4096 / 2**level]
            rest.append(md5(" ".join(inside), I.OTHER) if inside else "-")
    return [first, *rest]


def test_all_columns_against_brute_force(spark):
    rows = corpus(400)
    text = [t or "" for _, t in rows]
    freq = {}
    for t in text:
        for w in set(re.findall(r"[^\W_]+", t.lower())):
            freq[w] = freq.get(w, 0) + 1
    lo, hi = max(2.0, I.BAND[0] * len(rows)), max(3.0, I.BAND[1] * len(rows))
    lex = {w for w, n in freq.items() if lo <= n <= hi}
    assert len(lex) > 20
    line = sorted((d is None, d or 0, hashlib.md5((t or "").encode()).hexdigest()[:15], t or "", d) for d, t in rows)
    alike = lambda a, b: sum(x == y != "-" for x, y in zip(a, b)) / sum(x != "-" or y != "-" for x, y in zip(a, b))
    want = []
    for (*_, t, d), (*_, nxt, _) in zip(line, line[1:] + line[:1]):
        k = len(t) // 2
        e = t[: len(t) - k] + nxt[:k]
        a, b, c = (components(x, lex) for x in (t, e, nxt))
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), ".".join(a), ".".join(b), alike(a, b), alike(a, c)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = I.fingerprints(df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    import duckdb
    import pyarrow as pa

    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([{"doc_id": d, "text": t} for d, t in rows]))
    assert sorted(map(repr, con.execute(I.SQL).fetchall())) == sorted(map(repr, want))


def test_cells_are_bounded(spark):
    """One far id, one id on a third of the rows, and null ids on a fifth: no cell holds more than a few hundred rows."""
    ids = [10**15, -(2**62), *range(50_000), *[77] * 33_000, *[None] * 20_000]
    r = random.Random(2)
    df = spark.createDataFrame([(d, r.randrange(1 << 60)) for d in ids], "doc_id long, h long")
    placed = I.placed_in_cells(df, len(ids))
    assert placed.groupBy("cell").count().agg(F.max("count")).first()[0] <= 8 * I.PER_CELL
    line = sorted(((x.doc_id is None, x.doc_id or 0, x.h, x.cell) for x in placed.collect()), key=lambda x: x[:3])
    assert [x[3] for x in line] == sorted(x[3] for x in line)


def test_few_rows(spark):
    assert I.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    (g,) = I.fingerprints(spark.createDataFrame([(1, "abcd e")], "doc_id long, text string")).collect()
    assert g.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and g.near_next == 1.0
    nulls = I.fingerprints(spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")).collect()
    assert len(nulls) == 3 and {g.near_edited for g in nulls} == {1.0}
