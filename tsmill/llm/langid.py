"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum, over all
ways of cutting it into pieces, of the products of their probabilities, found by the forward algorithm; a text's is the
product over its words. The probabilities are learned by expectation maximisation from word counts of labelled texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tsmill.llm.common import cut, drop_cut, remainder

#: Labelled documents of each language that training reads, about: a hash of the document decides, whatever its place.
TRAIN_DOCS = 3000
ROUNDS = 2
#: Added to each piece's expected count.
SMOOTH = 0.01
UNKNOWN = 1e-9
#: Longest word that is summed in plain probabilities; longer ones are summed in logarithms.
PLAIN = 24
KEPT_WORDS = 250_000
WORDS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_vocabularies: dict[str, dict[str, int]] = {}


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Piece -> number; pieces that hold upper case, control names or no letter are of no use to lower-cased words."""
    path = path or default_path()
    if path not in _vocabularies:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        useful = [p for p in pieces if p == "▁" or (p == p.lower() and WORDS.fullmatch(p.removeprefix("▁")))]
        _vocabularies[path] = {p: i for i, p in enumerate(useful)}
    return _vocabularies[path]


class Forward:
    """Sums over segmentations for batches of words of equal length. theta: (pieces, languages)."""

    def __init__(self, pieces: dict[str, int], theta: np.ndarray):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        rows = np.zeros((1, theta.shape[1])), np.full((1, theta.shape[1]), UNKNOWN)
        self.theta = np.concatenate([theta, *rows])  # the last rows: no such piece, an unknown letter
        self.none, self.unknown = len(theta), len(theta) + 1
        self.log_theta = None  # of words too long for plain sums only

    def spans(self, n: int) -> list[tuple[int, int]]:
        return [(i, j) for j in range(1, n + 1) for i in range(max(0, j - self.longest), j)]

    def ids(self, words: list[str], spans: list[tuple[int, int]]) -> np.ndarray:
        get, none, unknown = self.pieces.get, self.none, self.unknown
        flat = [get(w[i:j], unknown if j - i == 1 else none) for w in words for i, j in spans]
        return np.array(flat, np.int32).reshape(len(words), len(spans))

    def equal(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """alpha (words, positions, languages), piece ids, spans."""
        n = len(words[0])
        spans = self.spans(n)
        ids = self.ids(words, spans)
        alpha = np.zeros((len(words), n + 1, self.theta.shape[1]))
        alpha[:, 0] = 1
        for k, (i, j) in enumerate(spans):
            alpha[:, j] += alpha[:, i] * self.theta[ids[:, k]]
        return alpha, ids, spans

    def long(self, word: str) -> np.ndarray:
        if self.log_theta is None:
            with np.errstate(divide="ignore"):
                self.log_theta = np.log(self.theta)
        log_theta = self.log_theta
        n, get = len(word), self.pieces.get
        a = np.full((n + 1, self.theta.shape[1]), -np.inf)
        a[0] = 0
        for j in range(1, n + 1):
            lo = max(0, j - self.longest)
            ids = [get(word[i:j], self.unknown if j - i == 1 else self.none) for i in range(lo, j)]
            a[j] = np.logaddexp.reduce(a[lo:j] + log_theta[ids], axis=0)
        return a[n]

    def log(self, words: list[str]) -> np.ndarray:
        """Logarithm of each word's probability: (words, languages). A word start is a symbol of its own."""
        out = np.empty((len(words), self.theta.shape[1]))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for n, at in by_length.items():
            if n > PLAIN:
                for k in at:
                    out[k] = self.long("▁" + words[k])
                continue
            for s in range(0, len(at), 4096):
                part = at[s : s + 4096]
                out[part] = np.log(self.equal(["▁" + words[k] for k in part])[0][:, -1])
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected number of times that each piece is used, for the first language."""
        out = np.zeros(len(self.theta))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for n, at in by_length.items():
            if n > PLAIN:
                together = max(1, 50_000 // n)
                for s in range(0, len(at), together):
                    part = at[s : s + together]
                    out += self.expected_long(["▁" + words[k] for k in part], counts[part])
                continue
            for s in range(0, len(at), 4096):
                part = at[s : s + 4096]
                alpha, ids, spans = self.equal(["▁" + words[k] for k in part])
                p = self.theta[:, 0][ids]
                beta = np.zeros(alpha.shape[:2])
                beta[:, -1] = 1
                for k in range(len(spans) - 1, -1, -1):
                    i, j = spans[k]
                    beta[:, i] += p[:, k] * beta[:, j]
                scale = counts[part] / alpha[:, -1, 0]
                for k, (i, j) in enumerate(spans):
                    out += np.bincount(ids[:, k], alpha[:, i, 0] * p[:, k] * beta[:, j] * scale, len(out))
        return out[: self.none]


    def expected_long(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """expected() for words of equal length, symbol of the word start included, summed in logarithms."""
        with np.errstate(divide="ignore"):
            log_theta = np.log(self.theta[:, 0])
        n = len(words[0])
        ids = self.ids(words, self.spans(n))
        p = log_theta[ids]
        ends = np.cumsum([min(j, self.longest) for j in range(n + 1)]).tolist()  # the spans that end at j: ends[j - 1] to ends[j]
        low = [max(0, j - self.longest) for j in range(n + 1)]
        a = np.full((len(words), n + 1), -np.inf)
        b = a.copy()
        a[:, 0] = b[:, n] = 0
        for j in range(1, n + 1):
            a[:, j] = np.logaddexp.reduce(a[:, low[j] : j] + p[:, ends[j - 1] : ends[j]], axis=1)
        for j in range(n, 0, -1):
            through = p[:, ends[j - 1] : ends[j]]
            through += b[:, j : j + 1]
            b[:, low[j] : j] = np.logaddexp(b[:, low[j] : j], through)
            through += a[:, low[j] : j]
        p -= a[:, n:]
        return np.bincount(ids.ravel(), (np.exp(p) * counts[:, None]).ravel(), len(self.theta))


# ---------------------------------------------------------------- learning
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    for b in batches:
        by: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(lang, Counter()).update(WORDS.findall(text.lower()))
        rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
        if rows:
            lang, w, n = zip(*rows)
            yield pa.record_batch([pa.array(lang), pa.array(w), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def sample(docs: DataFrame, per_language: int = TRAIN_DOCS) -> DataFrame:
    """About per_language rows (lang, text) of each language among rows with a lang and a text."""
    labelled = docs.where("lang is not null and text is not null").select("lang", "text", F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 30)).alias("h"))
    n = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for lang, k in n.items():
        rate = F.when(F.col("lang") == lang, F.lit(per_language / k)).otherwise(rate)
    return labelled.where(F.col("h") < rate * (1 << 30)).select("lang", "text")


def learn(docs: DataFrame, per_language: int = TRAIN_DOCS, rounds: int = ROUNDS, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages in order, and (pieces, languages) probabilities, learned from text and lang of docs."""
    pieces = vocabulary(path)
    counted = cut(sample(docs, per_language).mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    theta = np.full((len(pieces), max(1, len(langs))), 1.0)
    # at first a piece is as likely as its length is improbable: one letter in sixty, then halved again for each
    theta *= np.array([60.0 ** -min(len(p), 8) for p in pieces])[:, None]
    theta /= theta.sum(axis=0)
    at = {lang: k for k, lang in enumerate(langs)}

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        model = [Forward(vocab, now[:, [k]]) for k in range(len(at))]
        sums = np.zeros(now.shape)
        for b in batches:
            lang = np.array([at[x] for x in b.column(0).to_pylist()])
            words, n = b.column(1).to_pylist(), b.column(2).to_numpy().astype(float)
            for k in set(lang.tolist()):
                mine = np.flatnonzero(lang == k)
                sums[:, k] += model[k].expected([words[i] for i in mine], n[mine])
        piece, k = np.nonzero(sums)
        yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(sums[piece, k])], names=["k", "piece", "n"])

    for _ in range(rounds if langs else 0):
        now = theta
        # at most pieces x languages rows reach the driver
        got = counted.mapInArrow(expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        theta = np.full(theta.shape, SMOOTH)
        theta[got["piece"], got["k"]] += got["n"]
        theta /= theta.sum(axis=0)
    drop_cut(counted)
    return langs, theta


# ---------------------------------------------------------------- prediction
class Scorer:
    def __init__(self, langs: list[str], theta: np.ndarray, path: str | None):
        self.langs = np.array([UNDETERMINED, *langs], object)
        self.forward = Forward(vocabulary(path), theta)
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = [np.zeros((1, len(self.langs) - 1))]

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its probability, for each text."""
        if len(self.langs) == 1:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if len(self.index) > KEPT_WORDS:
            self.reset()
        index = self.index
        words = [WORDS.findall(t.lower()) if t else [] for t in texts]
        new = list({w for ws in words for w in ws if w not in index})
        held = [w for w in new if any(map(str.isalpha, w))]
        for w in new:
            index[w] = 0  # no letter: says nothing
        start = sum(map(len, self.rows))
        for k, w in enumerate(held):
            index[w] = start + k
        if held:
            self.rows = [np.concatenate([*self.rows, self.forward.log(held)])]
        table = self.rows[0]
        pred, prob = [], np.zeros(len(texts))
        for k, ws in enumerate(words):
            at = np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))
            if not at.any():
                pred.append(UNDETERMINED)
                continue
            total = table[at].sum(axis=0)
            e = np.exp(total - total.max())
            best = int(e.argmax())
            pred.append(self.langs[best + 1])
            prob[k] = e[best] / e.sum()
        return pred, prob


def predict(
    docs: DataFrame, langs: list[str], theta: np.ndarray, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """Columns keep of docs with lang_pred and score (0 to 1) from the column text alone; the model is of a fixed size.

    A text that is null or holds no letter gets "und" and 0; so does every text if no language was learned.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((langs, theta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value, path)
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                pred, prob = scorer.score(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(prob)], names=names)

    names = [*keep, "lang_pred", "score"]
    at = keep.index(text) if text in keep else len(keep)
    narrow = docs.select(*keep, *([] if text in keep else [text]))
    schema = StructType([*narrow.schema.fields[: len(keep)], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return narrow.mapInArrow(run, schema)


def identify(docs: DataFrame, per_language: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs.

    Learns from rows with a lang whose crc32(doc_id as text) mod 5 is not 0 (a null doc_id counts as empty text, so it
    is held out). Repeated rows each get a row; equal texts get equal answers. Columns beside doc_id, text and lang
    are not read, and lang only for learning.
    """
    held = remainder(5) == 0
    langs, theta = learn(docs.where(~held), per_language)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), langs, theta, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without rows whose text is null or holds no letter; if no language was learned, all that hold one stay."""
    held = remainder(5) == 0
    langs, theta = learn(docs.where(~held))
    if not langs:  # nothing tells languages apart: only the letters count
        langs, theta = ["any"], np.full((len(vocabulary()), 1), 1.0 / len(vocabulary()))
    # columns are numbered meanwhile, as docs may have a lang_pred or score of its own
    own = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    named = predict(docs.toDF(*own.values()), langs, theta, keep=tuple(own.values()), text=own["text"])
    return named.where(F.col("lang_pred") != UNDETERMINED).select(*(F.col(k).alias(c) for c, k in own.items()))
