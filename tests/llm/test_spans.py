import random
import re

from pyspark.sql import functions as F

from tsmill.llm import spans as S

M64 = (1 << 64) - 1


def word_hash(w):
    """The hash that chooses cuts, the plain way."""
    h = sum((c + 1) * pow(S._BASE, i, 1 << 64) for i, c in enumerate(w.lower())) & M64
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = ((h ^ (h >> 31)) * factor) & M64
    return h ^ (h >> 31)


def cut(text):
    """Sentences of text (words apart by white space), the plain way: (start, end, words)."""
    found = list(re.finditer(rb"[^ \t\n\x0b\x0c\r]+", text))
    h = [word_hash(m.group()) for m in found]
    least = {max(range(i, i + S.GAP), key=lambda j: (-h[j], j)) for i in range(len(h) - S.GAP + 1)}
    out, start, words = [], 0, 0
    for i, m in enumerate(found):
        words += 1
        nxt = found[i + 1].start() if i + 1 < len(found) else len(text)
        if m.group()[-1:] in b".!?" or i in least or b"\n" in text[m.end() : nxt] or i + 1 == len(found):
            out.append((start, nxt, words))
            start, words = nxt, 0
    return out


def plain(rows):
    """(doc_id, text) -> clean text, over distinct rows."""
    first, runs = {}, []
    for d, t in sorted(set(rows)):
        raw = t.encode()
        s = cut(raw)
        size = lambda i, j: sum(x[2] for x in s[i:j])
        spans = []
        for i in range(len(s)):
            j = next((j for j in range(i + 1, len(s) + 1) if size(i, j) >= S.LEAST_WORDS), None)
            if j:
                spans.append((i, j))
        if s:  # the run that ends with the text: the shortest of LEAST_WORDS words, or the whole
            spans.append((max((i for i in range(len(s)) if size(i, len(s)) >= S.LEAST_WORDS), default=0), len(s)))
        for i, j in dict.fromkeys(spans):
            key = tuple(tuple(raw[a:b].lower().split()) for a, b, _ in s[i:j])
            key = sum(key, ())
            runs.append((key, d, t, i, j))
            first.setdefault(key, (d, t, i))
    gone = {}
    for key, d, t, i, j in runs:
        if first[key] != (d, t, i):
            gone.setdefault((d, t), set()).update(range(i, j))
    return {r: b"".join(r[1].encode()[a:b] for k, (a, b, _) in enumerate(cut(r[1].encode())) if k not in gone.get(r, ())).decode() if r in gone else r[1] for r in set(rows)}


def upper(t):
    return t.encode().upper().decode()  # A-Z only


def corpus(seed, n):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) + r.choice(["", "", "", "", ".", ",", "!"]) for _ in range(900)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passages = [say(60) for _ in range(3)]
    rows = []
    for i in range(n):
        parts = [say(r.randint(0, 80)) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, upper(passages[i % 9 // 3]) if i % 2 else passages[i % 9 // 3])
        if i % 7 == 0:
            parts.append(parts[0])
        rows.append((i, r.choice([" ", "\n"]).join(parts)))
    return rows, passages


def test_against_brute_force(spark):
    rows, passages = corpus(1, 150)
    rows += [rows[3], (7, rows[8][1]), (500, "a b. c"), (504, "A  b. c"), (505, "c a b."), (501, ""), (502, " \n"), (503, "word " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_removed", F.lit("clash")).withColumn("k", F.lit(1))
    got = S.remove_repeated(df.repartition(5)).collect()
    want = plain(rows)
    assert sorted((g.doc_id, g.text) for g in got) == sorted((d, want[d, t]) for d, t in rows)
    # a passage of over 50 words stays in one place only; a few words at its rims may remain
    text = [t for _, t in {(g.doc_id, " ".join(g.text.lower().split())) for g in got}]  # of a repeated row one
    for p in passages:
        w = p.lower().split()
        core = " ".join(w[20:40])
        assert sum(core in t for t in text) == 1


def test_clean_documents_stay(spark):
    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(120)) + ".") for i in range(40)]
    got = S.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((g.doc_id, g.text) for g in got) == rows and all(g.n_removed == 0 for g in got)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 50}" for i in range(40)) + "."
    rows = [(None, None), (None, long), (None, long + " more"), (1, None), (1, long), (1, long), (9223372036854775807, long)]
    out = S.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.count() == len(rows) and out.where("text is null").count() == 2
    assert S.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, long, 3), (2, long, 3), (3, "", 0)], "doc_id long, text string, n_chars long")
    assert {(x.doc_id, x.n_chars) for x in S.rid_of_repeats(docs).collect()} == {(1, 3), (3, 0)}
    narrow = spark.createDataFrame([(1, long), (2, long)], "doc_id int, text string")
    assert sorted(len(x.text) for x in S.remove_repeated(narrow).collect()) == [0, len(long)]


def staying(words, text):
    """Which of the passage's words, all distinct, text still holds."""
    held = set(text.lower().split())
    return [w in held for w in words]


def test_every_passage_of_51_words_is_found(spark):
    """Passages without stops, amid other words, some with equal endings or in capitals; what stays lies at the rims."""
    r = random.Random(4)
    said = iter(range(10**9))
    word = lambda end: f"{r.choice('abcdefghij')}{next(said)}{end}"
    rows, passages = [], []
    for g in range(400):
        end = ["$$$", "", "qq", "###"][g % 4]
        p = [word(end) for _ in range(51)]
        passages.append(p)
        for k in range(2):
            said_here = [upper(w) for w in p] if k and g % 8 > 4 else p
            parts = [word(end) for _ in range(r.randrange(40))], said_here, [word(end) for _ in range(r.randrange(40))]
            rows.append((2 * g + k, " ".join(sum(parts, []))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in S.remove_repeated(df).collect()}
    for g, p in enumerate(passages):
        assert all(staying(p, got[2 * g]))
        left = staying(p, got[2 * g + 1])
        gone = [i for i, x in enumerate(left) if not x]
        assert gone[0] <= S.RIMS[0] and 50 - gone[-1] <= S.RIMS[1]
        assert gone == list(range(gone[0], gone[-1] + 1))


def test_text_without_spaces(spark):
    r = random.Random(5)
    say = lambda n: "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    p = say(60)
    df = spark.createDataFrame([(1, say(33) + p + say(20)), (2, say(21) + p + say(50))], "doc_id long, text string")
    got = {x.doc_id: x.text for x in S.remove_repeated(df).collect()}
    assert p in got[1] and p[15:40] not in got[2] and len(got[2]) <= 71 + sum(S.RIMS)
