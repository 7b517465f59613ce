import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from tsmill.llm import langid as L


def test_forward_sums_all_segmentations():
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "aba", "ba"])}
    theta = np.random.default_rng(1).random((len(pieces), 3))
    f = L.Forward(pieces, theta)

    def brute(s):
        total = np.zeros(3)
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            parts, start = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    parts.append(s[start:k])
                    start = k
            parts.append(s[start:])
            p = np.ones(3)
            for x in parts:
                p *= theta[pieces[x]] if x in pieces else L.UNKNOWN if len(x) == 1 else 0
            total += p
        return np.log(total)

    words = ["a", "b", "abab", "aabba", "zab", "ababababa"]
    want = np.array([brute("▁" + w) for w in words])
    assert np.allclose(f.log(words), want)
    assert np.allclose(np.array([f.long("▁" + w) for w in words]), want)
    # expected counts: each letter of each word is covered once
    e = f.expected(["abab", "ba"], np.array([2.0, 3.0]))
    assert math.isclose(sum(n * len(p) for p, n in zip(pieces, e)), 2 * 5 + 3 * 3, rel_tol=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs, 100).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    held = got.where("held_out and n > 100").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[1] > 100 and held[0] > 0.97
    assert got.where("score < 0 or score > 1").count() == 0
    assert got.count() == docs.count()


def test_odd_rows(spark):
    rows = [(i, f"the house of the {w} and", "en", "s") for i, w in enumerate("abcdefghij")] + [(100 + i, f"das haus der {w} und", "de", None) for i, w in enumerate("abcdefghij")]
    odd = [(None, None, None, None), (1, None, "en", None), (2, "", "en", None), (3, "123 ½² _!", None, None), (3, "123 ½² _!", None, None), (4, "x" * 30000, None, None), (55, "the the", None, "z")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    got = L.identify(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(rows) + len(odd)
    assert got.where("doc_id in (3) and lang_pred = 'und' and score = 0").count() == 2
    assert got.where("doc_id = 55 and lang_pred = 'en'").count() == 1
    kept = L.keep_identified(df)
    assert kept.columns == df.columns and kept.where("doc_id = 3 or text is null or text = ''").count() == 1  # one row 3 of the 'en' rows
    assert L.identify(df.limit(0)).collect() == []
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(unlabelled).collect()} == {"und"}


def test_texts_with_letters_stay(spark):
    rows = [(10 * k + i, f"{a} {b} word{i}", a) for k, (a, b) in enumerate([("aa", "bb"), ("cc", "dd"), ("ee", "ff"), ("gg", "hh"), ("ii", "jj")]) for i in range(10)]
    rows += [(900, "\u16a0\u16a2", None), (901, "12 !", None), (902, None, None)]  # runes: every language is as likely
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for docs in (df, df.withColumn("lang", F.lit(None).cast("string"))):
        kept = {r.doc_id for r in L.keep_identified(docs).collect()}
        assert kept == {r[0] for r in rows if r[0] < 901}


def test_long_words_count_in_learning():
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "aba", "ba"])}
    f = L.Forward(pieces, np.random.default_rng(2).random((len(pieces), 1)))
    short, n = ["abab", "babz", "aabb"], np.array([2.0, 3.0, 0.5])
    assert np.allclose(f.expected_long(["▁" + w for w in short], n)[: f.none], f.expected(short, n))
    for length in (L.PLAIN + 1, 60, 3000):  # each letter of each word is covered once
        e = f.expected(["ab" * (length // 2) + "a" * (length % 2), "b" * length], np.array([2.0, 3.0]))
        assert math.isclose(sum(k * len(p) for p, k in zip(pieces, e)), 5 * (length + 1), rel_tol=1e-6)
