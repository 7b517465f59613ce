"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Words and word pairs of the training documents are counted by 64-bit hash. A count c is held as its level
1 + floor(log2 c) by inserting (n-gram, 1), ..., (n-gram, level) into a Bloom filter; asking for level after level until
one is missing gives the level back, never too low and seldom too high. The filter is broadcast, and
P(w | v) = (low(v w) + ALPHA * P(w)) / (high(v) + ALPHA), P(w) = (low(w) + 0.1) / (N + 0.1 (V + 1)), low and high being the
least and the largest count of a level: this sums to one at most over all w, but for false positives. The filter's size
is known before it is gathered; over MOST_MB it is not gathered, and the probes travel to its segments instead.

The base score needs exact counts. Tokens that make up over 1 / HOT of all (HOT of them at most) are looked up in a
broadcast table, the rest are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsmill.llm.common import cut, drop_cut, remainder

ALPHA = 1000.0
HOT = 2_000_000
MOST_MB = 400
#: Bits of the filter for each level held, and how many of them a level sets, all in one 64-bit word.
BITS, SET = 16, 4
#: Bits of a key of the filter: sorted keys of a task then lie so close that their distances take half as much room.
KEY_BITS = 48
#: Tokens that a task counts, and scores, together; segments of the filter: one for each PART training tokens.
TOGETHER, SCORED, PART = 1_500_000, 300_000, 700_000
END_TOKEN, START_TOKEN = b"\n", b" "  # no word holds white space
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(tokens: list[bytes]) -> np.ndarray:
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.array([h(t) for t in tokens], np.uint64)


def tokens_of(text: bytes | None) -> np.ndarray:
    """Hashes of the words of A-Z lower-cased text and one end."""
    return _hash([*text.lower().split(), END_TOKEN] if text else [END_TOKEN])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def pairs_of(h: np.ndarray) -> np.ndarray:
    """Key of each token with the one before it; the first follows a start mark."""
    before = np.concatenate([_hash([START_TOKEN]), h[:-1]])
    return mix(before * np.uint64(3) + mix(h)) >> np.uint64(64 - KEY_BITS)


# ---------------------------------------------------------------- counts
def _counted(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        h, n = np.unique(h, return_counts=True)
        return h, n
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[head], np.add.reduceat(n, head) if len(h) else n


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    """Values of a column, not all of them turned into Python objects at once."""
    for s in range(0, len(column), 500):
        yield from column.slice(s, 500).to_pylist()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(parts):
        h, n = _counted(np.concatenate(parts))
        for s in range(0, len(h), 200_000):
            yield pa.record_batch([pa.array(h[s : s + 200_000].view(np.int64)), pa.array(n[s : s + 200_000])], names=["h", "n"])

    parts, held = [], 0
    for b in batches:
        for t in _texts(b.column(0)):
            parts.append(tokens_of(t))
            held += len(parts[-1])
            if held >= TOGETHER:
                yield from flush(parts)
                parts, held = [], 0
    if parts:
        yield from flush(parts)


def _pair_blobs(segments: int):
    """For each segment of the hash's range, the sorted pair hashes and counts of up to TOGETHER tokens, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            h, n = _counted(np.concatenate(parts))
            bounds = np.searchsorted(_segment(h, segments), np.arange(segments + 1))
            at = [s for s in range(segments) if bounds[s] < bounds[s + 1]]
            rows = [(pack(h[bounds[s] : bounds[s + 1]]), n[bounds[s] : bounds[s + 1]]) for s in at]
            small = [pack_counts(n) for _, n in rows]
            for k in range(0, len(at), 64):
                yield pa.record_batch(
                    [pa.array(at[k : k + 64], pa.int32()), pa.array([h for h, _ in rows[k : k + 64]], pa.binary()), pa.array(small[k : k + 64], pa.binary())],
                    names=["segment", "h", "n"],
                )

        parts, held = [], 0
        for b in batches:
            for t in _texts(b.column(0)):
                parts.append(pairs_of(tokens_of(t)))
                held += len(parts[-1])
                if held >= TOGETHER:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


_FAR = np.uint64(0xFFFFFFFF)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as 32-bit distances; longer ones are marked and follow in full."""
    d = np.diff(keys, prepend=np.uint64(0))
    far = d >= _FAR
    return np.uint32(len(keys)).tobytes() + np.where(far, _FAR, d).astype(np.uint32).tobytes() + d[far].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    n = int(np.frombuffer(packed, np.uint32, 1)[0])
    d = np.frombuffer(packed, np.uint32, n, 4).astype(np.uint64)
    d[d == _FAR] = np.frombuffer(packed[4 + 4 * n :], np.uint64)
    return np.cumsum(d, dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    """Counts as bytes; larger ones are marked and follow in 32 bits, and those too large for these in 64."""
    wide, widest = n >= 255, n >= int(_FAR)
    return np.minimum(n, 255).astype(np.uint8).tobytes() + np.minimum(n[wide], int(_FAR)).astype(np.uint32).tobytes() + n[widest].astype(np.int64).tobytes()


def _unpack(h: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = unpack(h)
    c = np.frombuffer(n, np.uint8, len(h)).astype(np.int64)
    wide = c == 255
    end = len(h) + 4 * int(wide.sum())
    c[wide] = np.frombuffer(n[len(h) : end], np.uint32)
    c[c == int(_FAR)] = np.frombuffer(n[end:], np.int64)
    return h, c


def _by_segment(batches: Iterator[pa.RecordBatch]):
    """(segment, hashes, counts), from blobs sorted by segment."""
    now, parts = None, []
    for b in batches:
        for s, h, n in zip(*(c.to_pylist() for c in b.columns)):
            if s != now and parts:
                yield (now, *_counted(*map(np.concatenate, zip(*parts))))
                parts = []
            now = s
            parts.append(_unpack(h, n))
    if parts:
        yield (now, *_counted(*map(np.concatenate, zip(*parts))))


# ---------------------------------------------------------------- the filter
def level(c: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), 0 for 0."""
    return np.frexp(c.astype(float))[1].astype(np.int64)


def low(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, 2.0 ** (q - 1), 0.0)


def high(q: np.ndarray) -> np.ndarray:
    return 2.0**q - 1


def _place(h: np.ndarray, k: int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(mix(h) + np.uint64(k * int(_MIX) & 0xFFFFFFFFFFFFFFFF))
    word = (x >> np.uint64(32)) * np.asarray(words, np.uint64) >> np.uint64(32)
    mask = np.zeros(len(h), np.uint64)
    for i in range(SET):
        mask |= np.uint64(1) << (x >> np.uint64(6 * i) & np.uint64(63))
    return word.astype(np.int64), mask


def make_segment(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Words of a filter that holds the levels of the counts c of the hashes h."""
    q = level(c)
    words = np.zeros(max(1, -(-int(q.sum()) * BITS // 64)), np.uint64)
    for k in range(1, int(q.max(initial=0)) + 1):
        at, mask = _place(h[q >= k], k, len(words))
        np.bitwise_or.at(words, at, mask)
    return words


class LogFrequencyFilter:
    """Segments of the filter in order of the hashes they hold, each a bytes object, so that none is copied on its way."""

    def __init__(self, segments: list[bytes]):
        self.segments = segments

    def level(self, h: np.ndarray, sorted_: bool = False) -> np.ndarray:
        """The level of each hash, by one membership probe after the other."""
        order = None if sorted_ else np.argsort(h)
        h = h if sorted_ else h[order]
        q = np.zeros(len(h), np.int64)
        bounds = np.searchsorted(_segment(h, len(self.segments)), np.arange(len(self.segments) + 1))
        for segment, lo, hi in zip(self.segments, bounds, bounds[1:]):
            words, left, k = np.frombuffer(segment, np.uint64), np.arange(lo, hi), 1
            while len(left):
                at, mask = _place(h[left], k, len(words))
                left = left[(words[at] & mask) == mask]
                q[left] = k
                k += 1
        if sorted_:
            return q
        out = np.empty_like(q)
        out[order] = q
        return out


def _filter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s, h, c in _by_segment(batches):
        w = make_segment(h, c)
        yield pa.record_batch([pa.array([s], pa.int32()), pa.array([w.tobytes()], pa.binary()), pa.array([w.nbytes], pa.int64())], names=["segment", "words", "size"])


class Counts:
    """What training gives: exact word counts as a table, totals, and pair counts in packed blobs by segment."""

    def __init__(self, train: DataFrame):
        text = train.select(F.col("text").cast("binary").alias("text"))
        self.words = cut(text.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "words")
        n, v = self.words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.n, self.v = n, v
        self.denominator = n + 0.1 * (v + 1)
        self.segments = max(1, -(-n // PART))
        end = self.words.where(F.col("h") == int(_hash([END_TOKEN]).view(np.int64)[0])).first()
        self.docs = end["c"] if end else 0
        blobs = text.mapInArrow(_pair_blobs(self.segments), "segment int, h binary, n binary")
        # words go into the filter as well, under hashes of their own
        word_blobs = self.words.mapInArrow(self._word_blobs(), "segment int, h binary, n binary")
        self.blobs = blobs.unionByName(word_blobs).repartition("segment").sortWithinPartitions("segment")

    def _word_blobs(self):
        segments = self.segments

        def run(batches):
            for b in batches:
                h = word_key(b.column(0).to_numpy().view(np.uint64))
                n = b.column(1).to_numpy()
                order = np.argsort(h)
                h, n = h[order], n[order]
                bounds = np.searchsorted(_segment(h, segments), np.arange(segments + 1))
                for s in np.flatnonzero(np.diff(bounds)).tolist():
                    packed = pack_counts(n[bounds[s] : bounds[s + 1]])
                    yield pa.record_batch([pa.array([s], pa.int32()), pa.array([pack(h[bounds[s] : bounds[s + 1]])], pa.binary()), pa.array([packed], pa.binary())], names=["segment", "h", "n"])

        return run

    def hot(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and counts of the tokens that make up over 1 / HOT of all: HOT at most."""
        rows = self.words.where(F.col("c") * HOT > self.n).toArrow()
        h = rows.column(0).to_numpy().view(np.uint64)
        order = np.argsort(h)
        return h[order], rows.column(1).to_numpy()[order]


def word_key(h: np.ndarray) -> np.ndarray:
    """Key of a word in the filter, apart from its pairs."""
    return mix(h + np.uint64(1)) >> np.uint64(64 - KEY_BITS)


# ---------------------------------------------------------------- scores
def _ends(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def score(docs: DataFrame, train: DataFrame, keep: tuple[str, ...] = ("doc_id",), most_mb: float = MOST_MB, alpha: float = ALPHA) -> DataFrame:
    """Columns keep of docs with n_tokens, n_known, train_tokens, base_score, score of the column text."""
    spark = docs.sparkSession
    counts = Counts(train)
    n, denominator, start_high = counts.n, counts.denominator, float(counts.docs)
    hot_h, hot_c = counts.hot()
    segments = counts.segments
    rows = cut(counts.blobs.mapInArrow(_filter_rows, "segment int, words binary, size long"), "filter")
    size = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    by_filter = size <= most_mb * 1e6
    model = None
    if by_filter:
        words = [bytes(8)] * segments
        for r in rows.select("segment", "words").toLocalIterator():  # one partition's segments at a time
            words[r["segment"]] = bytes(r["words"])
        model = LogFrequencyFilter(words)
        del words
        drop_cut(rows)
    shared = spark.sparkContext.broadcast((model, hot_h, hot_c))
    del model

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, hot, c = shared.value
        logs = np.log10(c + 0.1)
        wide = len(keep)

        def flush(part: pa.RecordBatch, found: list[np.ndarray]):
            ends = _ends([len(x) for x in found])
            h = np.concatenate(found)
            doc = np.repeat(np.arange(len(found)), np.diff(ends))
            u, inverse = np.unique(h, return_inverse=True)
            at = np.searchsorted(hot, u)
            is_hot = np.zeros(len(u), bool)
            if len(hot):
                at[at == len(hot)] = 0
                is_hot = hot[at] == u
            mine = is_hot[inverse]
            base = np.bincount(doc, np.where(mine, logs[at[inverse]] if len(hot) else 0.0, 0.0), len(found))
            known = np.bincount(doc, mine, len(found)).astype(np.int64)
            total = np.zeros(len(found))
            if lm is not None:
                q = lm.level(word_key(u))[inverse]
                pair = np.concatenate([pairs_of(x) for x in found])
                p, back = np.unique(pair, return_inverse=True)
                total = _log_probability(q, lm.level(p, sorted_=True)[back], ends, denominator, start_high, alpha)
            rare = np.flatnonzero(~mine)  # tokens to be joined: one row for each token of a document, with its number
            key = doc[rare].astype(np.int64) * len(u) + inverse[rare]
            key, times = np.unique(key, return_counts=True)
            r_doc, r_u = key // max(1, len(u)), key % max(1, len(u))
            cuts = np.searchsorted(r_doc, np.arange(len(found) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(u[r_u].view(np.int64)), pa.array(times.astype(np.int32))], names=["h", "t"]))
            return pa.RecordBatch.from_arrays(
                [*part.columns[:wide], part.column(wide), pa.array(np.diff(ends)), pa.array(known), pa.array(base), pa.array(total), lists],
                names=names,
            )

        for b in batches:
            found, lo, held = [], 0, 0
            for i, t in enumerate(_texts(b.column(wide + 1))):
                found.append(tokens_of(t))
                held += len(found[-1])
                if held >= SCORED:
                    yield flush(b.slice(lo, i + 1 - lo), found)
                    found, lo, held = [], i + 1, 0
            if found:
                yield flush(b.slice(lo), found)

    # rows are told apart by their kept columns and text; rows that agree in all of them have equal scores
    key = F.xxhash64(*keep, "text").alias("__k")
    narrow = docs.select(*keep, key, F.col("text").cast("binary").alias("__text"))
    names = [*keep, "__k", "n_tokens", "known", "base", "total", "rare"]
    types = ", ".join(f"`{c}` {t}" for c, t in narrow.select(*keep).dtypes)
    passed = narrow.mapInArrow(read, f"{types}, __k long, n_tokens long, known long, base double, total double, rare array<struct<h: long, t: int>>")
    passed = cut(passed, "read")
    occurrences = passed.select("__k", F.explode("rare").alias("r")).select("__k", F.col("r.h").alias("h"), F.col("r.t").alias("t"))
    cold = counts.words.where(F.col("c") * HOT <= n)
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = (
        occurrences.join(cold, "h", "left")
        .groupBy("__k")
        .agg(F.sum(F.col("t") * F.log10(c + F.lit(0.1))).alias("rest"), F.sum(F.when(c > 0, F.col("t")).otherwise(0)).alias("more"))
    )
    # the sums of rows that agree were added up: divide by their number
    copies = passed.groupBy("__k").agg(F.count("*").alias("copies")).where("copies > 1")
    out = passed.drop("rare").join(rest, "__k", "left").join(copies, "__k", "left")
    times = F.coalesce("copies", F.lit(1))
    if not by_filter:
        out = out.drop("total").join(_score_in_segments(narrow, rows, counts, alpha), "__k", "left")
    return out.select(
        *keep,
        "n_tokens",
        (F.col("known") + F.coalesce(F.col("more") / times, F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("rest") / times, F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(denominator)))).alias("base_score"),
        F.col("total").alias("score"),
    )


def _probes(h_words: np.ndarray, h_pairs: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys that a group of documents asks the filter for, and where each segment's begin."""
    keys = np.unique(np.concatenate([word_key(h_words), h_pairs]))
    return keys, np.searchsorted(_segment(keys, segments), np.arange(segments + 1))


def _score_in_segments(narrow: DataFrame, rows: DataFrame, counts: Counts, alpha: float) -> DataFrame:
    """__k, total: the same scores from a filter of any size. Its segments stay where they are, and the probes of groups
    of documents travel to them and come back as levels; each document's text moves once."""
    segments, denominator, start_high = counts.segments, counts.denominator, float(counts.docs)
    groups = max(1, -(-counts.n // SCORED))
    asked = narrow.select("__k", "__text", F.pmod(F.xxhash64("__k"), F.lit(groups)).cast("int").alias("f"))

    def read(table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        order = np.argsort(table.column("__k").to_numpy(), kind="stable")
        found = [tokens_of(t) for t in table.column("__text").to_pylist()]
        found = [found[i] for i in order]
        return found, table.column("__k").to_numpy()[order], np.concatenate(found)

    def ask(key, table):
        found, _, h = read(table)
        keys, cuts = _probes(h, np.concatenate([pairs_of(x) for x in found]), segments)
        at = np.flatnonzero(np.diff(cuts)).tolist()
        parts = [pack(keys[cuts[s] : cuts[s + 1]]) for s in at]
        return pa.table({"segment": pa.array(at, pa.int32()), "f": pa.array([key[0].as_py()] * len(at), pa.int32()), "h": pa.array(parts, pa.binary())})

    def answer(key, left, right):
        words = left.column("words").to_pylist()[0] if left.num_rows else bytes(8)
        one = LogFrequencyFilter([words])
        levels = [one.level(unpack(h), sorted_=True).astype(np.uint8).tobytes() for h in right.column("h").to_pylist()]
        return pa.table({"f": right.column("f"), "segment": right.column("segment"), "q": pa.array(levels, pa.binary())})

    def finish(key, left, right):
        if not right.num_rows:
            return pa.table({"__k": pa.array([], pa.int64()), "total": pa.array([], pa.float64())})
        found, ks, h = read(right)
        pairs = np.concatenate([pairs_of(x) for x in found])
        keys, _ = _probes(h, pairs, segments)
        order = np.argsort(left.column("segment").to_numpy())
        blobs = left.column("q").to_pylist()
        q = np.frombuffer(b"".join([blobs[i] for i in order]), np.uint8).astype(np.int64)
        of = lambda x: q[np.searchsorted(keys, x)]
        ends = _ends([len(x) for x in found])
        totals = _log_probability(of(word_key(h)), of(pairs), ends, denominator, start_high, alpha)
        return pa.table({"__k": pa.array(ks), "total": pa.array(totals)})

    probes = asked.groupBy("f").applyInArrow(ask, "segment int, f int, h binary")
    levels = rows.select("segment", "words").groupBy("segment").cogroup(probes.groupBy("segment")).applyInArrow(answer, "f int, segment int, q binary")
    totals = levels.groupBy("f").cogroup(asked.groupBy("f")).applyInArrow(finish, "__k long, total double")
    return totals.groupBy("__k").agg(F.first("total").alias("total"))  # rows that agree have equal scores


def _log_probability(q: np.ndarray, both: np.ndarray, ends: np.ndarray, denominator: float, start_high: float, alpha: float) -> np.ndarray:
    """Log10 probability of each document from the levels of its words and pairs; ends: where documents begin and end."""
    before = np.concatenate([[0.0], high(q[:-1])])
    before[ends[:-1]] = start_high
    prob = (low(both) + alpha * (low(q) + 0.1) / denominator) / (before + alpha)
    return np.add.reduceat(np.log10(prob), ends[:-1])


def score_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Learns from rows whose crc32(doc_id as text) mod 10 is not 0 (a null doc_id counts as empty text and is held out).
    A null or blank text is one end token. Repeated rows count and are scored each. Columns beside doc_id and text
    are not read.
    """
    held = remainder(10) == 0
    return score(docs.select("doc_id", held.alias("held_out"), "text"), docs.where(~held), ("doc_id", "held_out"), **options)
