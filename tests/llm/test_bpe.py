import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tsmill.llm import bpe as B


@pytest.fixture(scope="module")
def both():
    b = B.load(B.default_path())
    return b, b.library


CASES = ["", " ", "Hello, World's  best!!", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "don't we'll 'sabc ''s", "É́é ẞ İstanbul ΣΑΣ ſ", "x y\x85z\x1c\x1d w\x7f", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "½²3٣ 漢字 🎉🎉 ½", "\x00\x01a\tb", "a" * 3000 + "b", "of" * 2000, " x　y", "<|", "º ª µ"]


@pytest.mark.parametrize("text", CASES)
def test_cases(both, text):
    ours, lib = both
    ids = lib.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == ids
    assert ours.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    n, a, b = ours.digest(text)
    assert (n, a) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert b == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcdeinorst'. é", max_size=80) | st.text(alphabet=st.characters(max_codepoint=0x17F), max_size=40))
def test_any_text(both, text):
    ours, lib = both
    ids = lib.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == ids
    assert ours.digest(text)[0] == len(ids)


def test_joined_words(both):
    ours, lib = both
    r = random.Random(1)
    tokens = [t.replace("</w>", "") for t in random.Random(2).sample(sorted(lib.get_vocab()), 4000)]
    for _ in range(1500):
        text = "".join(r.choice(tokens) for _ in range(r.randint(1, 6)))
        text = "".join(c for c in text if c.isascii())
        assert ours.encode(text) == lib.encode(text, add_special_tokens=False).ids, text


def test_tables(spark, both):
    rows = [(1, "Ab cd"), (1, "Ab cd"), (2, None), (3, ""), (None, "x"), (4, "word " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = sorted(map(tuple, B.digests(df).collect()), key=str)
    lib = both[1]
    want = []
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    round_trip = B.decode_documents(B.encode_documents(df)).where("doc_id = 1").first()
    assert round_trip.decoded == lib.decode(round_trip.token_ids, skip_special_tokens=False) and round_trip.n_tokens == "clash"
    assert B.digests(df.limit(0)).collect() == []


def test_narrow_ids(spark):
    from tsmill.llm import bpe

    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id int, text string")
    assert {x.doc_id: x.n_tokens for x in bpe.digests(df).collect()}[None] == 0
