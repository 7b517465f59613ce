"""Substring dedup by sliding sentence spans.

A text is cut into sentences, every run of several consecutive sentences is hashed, runs are compared over all
documents, and the sentences that a repeated run covers are removed everywhere but at its first place.

A sentence ends after a word that ends in . ! or ?, at a line end and, as passages are often set into the middle of
other sentences, after the word of least hash in each GAP consecutive words: such cuts depend on these words alone, so a
passage is cut alike wherever it stands, and no sentence is longer than GAP words. Case (of A-Z) and white space do not
count. A run starts at each sentence and ends with the first one that brings it to LEAST_WORDS words, so it always holds
several sentences; one more run ends with the text, and a text of fewer words is one run. A passage of 51 words is
found at any place: RIMS words at most stay at its start and at its end.

In scripts written without spaces (Han, kana, Thai, Lao, Khmer, Myanmar) each character is a word; any other stretch
without white space is one word, however long. Runs are compared by 63-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

GAP, LEAST_WORDS = 6, 15
#: Words of a passage of 51 words or more that may stay at its start and its end: a cut that both places share
#: lies 2 * GAP - 1 words from a rim at most, and the last run may end GAP - 1 words before it.
RIMS = (2 * GAP - 1, 3 * GAP - 2)
#: Runs that a task looks at together before it sends them on.
TOGETHER = 400_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(16, n.bit_length())
        _powers[:] = [np.cumprod(np.array([1] + [x] * size, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch values[start:end], from running sums of values times powers."""
    up, down = _base_powers(len(values))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * down[starts]
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _units(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words, characters of scripts without spaces being words."""
    space = np.concatenate([[True], _SPACE[b], [True]])
    start = space[:-1] & ~space[1:]
    if len(b) and b.max() >= 0xE0:
        second = np.append(b[1:], 0)
        three = (b >= 0xE3) & (b <= 0xE9)
        three |= (b == 0xE0) & (second >= 0xB8) & (second <= 0xBB)
        three |= (b == 0xE1) & ((second >= 0x80) & (second <= 0x82) | (second == 0x9E) | (second == 0x9F))
        four = (b == 0xF0) & (second >= 0xA0) & (second <= 0xB3)
        for lead, size in ((three, 3), (four, 4)):
            at = np.flatnonzero(lead)
            start[at] = True
            start[np.minimum(at + size, len(b))] = True
        start &= ~space[1:]
    starts = np.flatnonzero(start[:-1])
    ends = np.flatnonzero(~space[:-1] & (space[1:] | start))
    return starts, ends


def sentences(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets at which sentences start, the end of the text last; the word each starts with, the number of words
    last; and a hash of each word."""
    b = np.frombuffer(text, np.uint8)
    starts, ends = _units(b)
    if not len(starts):
        return np.array([0, len(b)]), np.zeros(2, np.int64), np.zeros(0, np.uint64)
    words = _hashes(_LOWER[b] + np.uint64(1), starts, ends)
    closed = _STOP[b[ends - 1]]
    lines = np.concatenate([[0], np.cumsum(b == 10)])
    following = np.append(starts[1:], len(b))
    closed |= lines[following] > lines[ends]
    if len(starts) >= GAP:
        windows = np.lib.stride_tricks.sliding_window_view(words, GAP)
        closed[np.arange(len(windows)) + GAP - 1 - windows[:, ::-1].argmin(axis=1)] = True  # of equal ones the last
    closed[-1] = True
    at = np.flatnonzero(closed)
    return np.concatenate([[0], following[at]]), np.concatenate([[0], at + 1]), words


def run_bounds(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentences at which runs start, and the sentences after their last; run k starts at sentence k but for the last run."""
    n = len(first) - 1
    end = np.searchsorted(first, first[:-1] + LEAST_WORDS)
    end = end[end <= n]
    begin = np.arange(len(end))
    if first[-1] and (not len(end) or end[-1] < n):
        begin = np.append(begin, max(0, np.searchsorted(first, first[-1] - LEAST_WORDS, "right") - 1))
        end = np.append(end, n)
    return begin, end


def runs(text: bytes) -> np.ndarray:
    """Hash of each run, a multiple of two."""
    _, first, words = sentences(text)
    begin, end = run_bounds(first)
    return (_hashes(words, first[begin], first[end]) & ~np.uint64(1)).view(np.int64)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (p, k, sub). Of places with one hash, those not the least here are repeats for certain: they are dealt out
    freely (odd p), so that a hash sends one row for each task and TOGETHER runs, however often it occurs."""

    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        h, k, sub = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((sub, k, h))
        h, k, sub = h[order], k[order], sub[order]
        new = np.ones(len(h), bool)  # a row that repeats a document has the same places
        new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1]) | (sub[1:] != sub[:-1])
        h, k, sub = h[new], k[new], sub[new]
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        p = np.where(again, h ^ (k * np.int64(-7046029254386353131)) ^ (sub * np.int64(-4417276706812531889)) | 1, h)
        for s in range(0, len(h), 100_000):
            e = s + 100_000
            yield pa.record_batch([pa.array(p[s:e]), pa.array(k[s:e]), pa.array(sub[s:e])], names=["p", "k", "sub"])

    parts, held = [], 0
    for b in batches:
        for k, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            h = runs(text)
            if len(h):
                parts.append((h, np.full(len(h), k), np.int64(th) << 32 | np.arange(len(h))))
                held += len(h)
        if held >= TOGETHER:
            yield from flush(parts)
            parts, held = [], 0
    if parts:
        yield from flush(parts)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places (k, sub) of runs other than the first, from rows sorted by p, k, sub."""
    first = None  # of the hash that the last batch ended with: (p, k, sub)
    for b in batches:
        if not b.num_rows:
            continue
        p, k, sub = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        head = np.ones(len(p), bool)
        head[1:] = p[1:] != p[:-1]
        start = np.flatnonzero(head)[np.cumsum(head) - 1]
        k0, sub0 = k[start], sub[start]
        if first and first[0] == p[0]:
            k0[start == 0], sub0[start == 0] = first[1:]
        keep = (p & 1 > 0) | (k != k0) | (sub != sub0)
        first = p[-1], k0[-1], sub0[-1]
        yield pa.record_batch([pa.array(k[keep]), pa.array(sub[keep])], names=["k", "sub"])


def _key(columns=("doc_id", "text")):
    doc, text = map(F.col, columns)
    th = F.xxhash64(text)
    return F.coalesce(doc.cast("long"), th).alias("__k"), F.shiftrightunsigned(th, 33).cast("int").alias("__th")


def _staying(first: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which sentences none of the runs numbered in places covers."""
    begin, end = run_bounds(first)
    drop = np.zeros(len(first), np.int64)
    np.add.at(drop, begin[places], 1)
    np.add.at(drop, end[places], -1)
    return np.cumsum(drop)[:-1] == 0


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", numbers: tuple[str, str] = ("n_sentences", "n_removed")) -> DataFrame:
    """docs with text rid of sentences covered by a repeated run that is not its first, plus two numbers.

    The first place is the smallest (doc_id, hash of the text, sentence). Rows that agree in doc_id and text are one
    document: each gets the same result. A null doc_id takes a place given by a hash of the text. Null and blank texts
    are left as they are; of equal texts the first stays whole, and the others lose all they hold. No rows: no rows.
    Texts are taken whole, whatever their length. Other columns pass through; those named like the two new numbers are replaced.
    """
    docs = docs.select(*(c for c in docs.columns if c not in numbers))
    k, th = _key((doc_id, text))
    narrow = docs.where(F.col(text).isNotNull()).select(k, th, F.col(text).cast("binary").alias("b"))
    rows = narrow.mapInArrow(_emit, "p long, k long, sub long")
    found = rows.repartition("p").sortWithinPartitions("p", "k", "sub").mapInArrow(_repeats, "k long, sub long")
    # rows repeating a document give its places twice; a document's list is as long as the document at most
    places = found.groupBy(F.col("k").alias("__k2"), F.shiftright("sub", 32).cast("int").alias("__th2")).agg(
        F.collect_set(F.col("sub").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("__places")
    )
    marked = docs.withColumns({"__k": k, "__th": th})
    joined = marked.join(places, (F.col("__k") == F.col("__k2")) & (F.col("__th") == F.col("__th2")), "left").drop("__k", "__th", "__k2", "__th2")
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, gone = b.column(at).to_pylist(), [], []
            for i, places in enumerate(b.column(b.num_columns - 1).to_pylist()):
                raw = (texts[i] or "").encode()
                bounds, first, words = sentences(raw)
                removed = 0
                if places:
                    stay = _staying(first, np.array(places))
                    removed = int((~stay).sum())
                    texts[i] = np.frombuffer(raw, np.uint8)[np.repeat(stay, np.diff(bounds))].tobytes().decode()
                total.append(len(first) - 1 if len(words) else 0)
                gone.append(removed)
            columns = [pa.array(texts, pa.string()) if j == at else c for j, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int32()), pa.array(gone, pa.int32())], names=names)

    names = [*docs.columns, *numbers]
    schema = StructType([*docs.schema.fields, *(StructField(n, IntegerType()) for n in numbers)])
    assert isinstance(schema[text].dataType, StringType)
    return joined.mapInArrow(clean, schema)


def rid_of_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages removed and n_chars renewed; documents of which nothing is left go.

    Nulls, ties, repeated rows and long texts: see remove_repeated(). Columns of any name pass through.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    out = remove_repeated(docs.toDF(*own.values()), own["doc_id"], own["text"], ("n", "gone"))
    out = out.where((F.col("gone") == 0) | (F.regexp_count(own["text"], F.lit(r"\S")) > 0))
    renewed = {c: F.col(k) for c, k in own.items()}
    if "n_chars" in own:
        renewed["n_chars"] = F.when(F.col("gone") > 0, F.length(own["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own["n_chars"]))
    return out.select(*(v.alias(c) for c, v in renewed.items()))
