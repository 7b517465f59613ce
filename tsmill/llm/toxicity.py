"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades 0 < 1 < ... < K are modelled by P(grade <= k) = sigmoid(cut_k - w . x): one weight vector for all thresholds, and
rising cuts. x marks which of the chosen words a text holds. The answer is the expected grade, sum over k of P(grade > k).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsmill.llm.common import cut, drop_cut, remainder

#: Labelled rows that training reads at most, those with the smallest hash of their id.
TRAIN_ROWS = 20_000
#: Words of the model: the least chi-square between word and grade > 0, and the least documents of the sample that hold them.
LEAST_CHI, LEAST_DOCS = 12.0, 5
STEPS, RATE, DECAY = 400, 0.05, 1.0
WORDS = re.compile(r"[^\W\d_]+")


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Ordinal:
    """words: word -> place in weight; cuts: one fewer than the grades."""

    words: dict[str, int]
    weight: np.ndarray
    cuts: np.ndarray

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one row for each z = w . x."""
        return _sigmoid(z[:, None] - self.cuts)

    def logit(self, text: str | None) -> float:
        """w . x; a text without a word says nothing and is of grade 0 for certain."""
        words = set(WORDS.findall(text.lower())) if text else ()
        if not words:
            return -np.inf
        return float(sum(sorted(self.weight[self.words[w]] for w in self.words.keys() & words)))


def fit_ordinal(rows: list[np.ndarray], grade: np.ndarray, n_features: int, n_grades: int, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts by full-batch Adam on the penalised likelihood; deterministic."""
    n, top = len(rows), n_grades - 1
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    share = np.array([(np.sum(grade <= k) + 0.5) / (n + 1.0) for k in range(top)])
    cuts = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(cuts), 1e-3))
    p = np.concatenate([np.zeros(n_features), cuts[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    lo, hi = grade - 1, grade
    for t in range(1, steps + 1):
        w = p[:n_features]
        cuts = p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1 :]))])
        z = np.bincount(row, w[at], n)
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        a, b = _sigmoid(edge[lo + 1] - z), _sigmoid(edge[hi + 1] - z)
        prob = np.maximum(b - a, 1e-12)
        da, db = a * (1 - a), b * (1 - b)
        gz = (db - da) / prob  # d(-log prob)/dz
        g_cut = np.bincount(hi, -db / prob, n_grades)[:top] + np.bincount(np.maximum(lo, 0), np.where(lo >= 0, da / prob, 0.0), n_grades)[:top]
        later = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(at, gz[row], n_features) + decay * w, later[:1], later[1:] * np.exp(p[n_features + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    cuts = p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1 :]))])
    return p[:n_features], cuts


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [sorted(set(WORDS.findall(t.lower()))) for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(words, pa.list_(pa.string()))], names=["grade", "words"])


def learn(docs: DataFrame, grades: DataFrame, most: int = TRAIN_ROWS) -> Ordinal:
    """grades: doc_id, grade (0, 1, ...), a row for each labelled document at most; the smallest hashes train, `most` rows at most."""
    chosen = grades.where("doc_id is not null and grade is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(most)
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", F.col("grade").cast("int").alias("grade"))), "doc_id")
    texts = texts.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(most)  # repeated ids: no more rows than that
    sets = cut(texts.select("grade", "text").mapInArrow(_word_sets, "grade int, words array<string>"), "toxicity")
    n, positive, top = sets.agg(F.count("*"), F.sum((F.col("grade") > 0).cast("int")), F.max("grade")).first()
    if not n or not positive or positive == n:  # one grade, or none: nothing to tell apart
        drop_cut(sets)
        return Ordinal({}, np.zeros(0), np.full(max(1, top or 1), -30.0 if n and positive == n else 30.0))
    a = F.sum((F.col("grade") > 0).cast("double")).alias("a")
    table = sets.select("grade", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").cast("double").alias("d"), a).where(F.col("d") >= LEAST_DOCS)
    expect = F.col("d") * positive / n
    chi = (F.col("a") - expect) ** 2 * n / (expect * (F.lit(float(n)) - positive) * (F.lit(float(n) + 1e-9) - F.col("d")) / n)
    best = table.withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI).orderBy("word")
    words = {r["word"]: k for k, r in enumerate(best.select("word").collect())}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [[words[w] for w in ws if w in words] for ws in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(at, pa.list_(pa.int32()))], names=["grade", "at"])

    got = sets.mapInArrow(places, "grade int, at array<int>").toArrow()
    drop_cut(sets)
    rows = [np.array(x, np.int64) for x in got.column(1).to_pylist()]
    order = sorted(range(len(rows)), key=lambda i: (got.column(0)[i].as_py(), rows[i].tolist()))  # sums do not depend on how rows arrive
    grade = np.array([got.column(0)[i].as_py() for i in order], np.int64)
    weight, cuts = fit_ordinal([rows[i] for i in order], grade, len(words), top + 1)
    return Ordinal(words, weight, cuts)


def severity(docs: DataFrame, model: Ordinal, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep of docs with severity (expected grade), grade (the most probable) and toxic (P(grade > 0) >= 1/2).

    The model holds words of the sample that it learned from, so its size is bounded. A null text or one without words is of grade 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            z = np.array([m.logit(t) for t in b.column(len(keep)).to_pylist()], float)
            above = m.above(z)
            probs = np.diff(np.concatenate([np.zeros((len(z), 1)), 1 - above, np.ones((len(z), 1))], axis=1))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(above.sum(axis=1)), pa.array(probs.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= 0.5)],
                names=[*keep, "severity", "grade", "toxic"],
            )

    narrow = docs.select(*keep, "text")
    schema = ", ".join(f"`{c}` {t}" for c, t in narrow.dtypes[:-1]) + ", severity double, grade int, toxic boolean"
    return narrow.mapInArrow(run, schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade from labels: 0 not toxic, 1 toxic, 2 toxic and of low quality; of several rows the worst counts."""
    g = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))
    return labels.groupBy("doc_id").agg(F.max(g).alias("grade"))


def rate(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, severity, grade, toxic of every row of docs.

    Learns from labels of documents whose crc32(doc_id as text) mod 5 is not 0. Rows with a null doc_id count as held
    out; repeated rows each get a row; labels without a document or with null toxic teach nothing; without any
    toxic label every severity is about 0. Columns beside doc_id and text are not read.
    """
    held = remainder(5) == 0
    model = learn(docs, grades_of(labels.where(~held)), most)
    return severity(docs.select("doc_id", held.alias("held_out"), "text"), model, ("doc_id", "held_out"))
