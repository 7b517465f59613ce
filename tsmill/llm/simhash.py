"""SimHash near-duplicate groups found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into two segments of 23 bits (A, B) and a rest of 18 bits (two halves C1, C2 of 9).
The perfect binary Golay code [23,12,7] gives every 23-bit word one codeword within three bits. The keys of a
segment are the codeword indices reached from the word and its 23 one-bit neighbours: one key if the word lies
within two bits of its codeword, six otherwise. Two words that differ in two bits or fewer share a key, because
the word half way between them decodes to an index that both hold.

Three differing bits, dealt over A, B and C as (a, b, c), are always met by one of these key families:

* a, b <= 2 and C1 or C2 untouched: key(A) x key(B) x C1, key(A) x key(B) x C2   (c <= 1)
* a = 0, b <= 2: A x key(B);  b = 0, a <= 2: B x key(A)                         (every c >= 2 has a + b <= 1)
* a = 3: B x C;  b = 3: A x C

Fingerprints that share a key are verified by their exact distance. Rows are held by distinct fingerprint, so
copies cost nothing, and a bucket emits a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsmill.llm.common import connected_components, cut

MAX_BITS = 3
#: Members of a bucket above which links are found through one-bit neighbourhoods (linear) rather than by comparing members.
COMPARE = 2048


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(words: list[bytes], width: int) -> list[int]:
    """XXH64 (seed 42) of each shingle of `width` words; all words together if they are fewer."""
    import xxhash

    n = len(words)
    joined = b" ".join(words)
    if n <= width:
        return [xxhash.xxh64_intdigest(joined, 42)]
    sizes = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: n - width + 1].tolist()
    stops = (ends - 1)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], 42) for s, e in zip(starts, stops)]


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Majority SimHash over XXH64 (seed 42) of the word shingles of lower-cased text; no word: 0."""
    if text is None:
        return 0
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    return majority(np.array(shingle_hashes(words, width), np.uint64))


def majority(a: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(a), 65536):
        bits += np.unpackbits(a[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(a), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row, from shingles of `width` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- the code
@lru_cache(1)
def decode_table() -> np.ndarray:
    """For each 23-bit word: index of its codeword in the low 12 bits, bit 15 set at distance three.

    Codewords are systematic: the index is the upper 12 bits. Built from the generator x^11+x^10+x^6+x^5+x^4+x^2+1.
    """
    poly = 0b110001110101

    def syndrome(words: np.ndarray) -> np.ndarray:
        r = words.copy()
        for k in range(22, 10, -1):
            r ^= np.where(r >> k & 1, poly << (k - 11), 0).astype(r.dtype)
        return r

    errors = np.zeros(2048, np.int32)
    one = [1 << i for i in range(23)]
    patterns = [0] + one + [one[i] | one[j] for i in range(23) for j in range(i)]
    patterns += [one[i] | one[j] | one[k] for i in range(23) for j in range(i) for k in range(j)]
    p = np.array(patterns, np.int32)
    errors[syndrome(p)] = p
    words = np.arange(1 << 23, dtype=np.int32)
    e = errors[syndrome(words)]
    three = np.bitwise_count(e.astype(np.uint32)) == 3
    return ((words ^ e) >> 11).astype(np.uint16) | (three.astype(np.uint16) << 15)


def segment_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of each 23-bit word; unused places are -1."""
    table = decode_table()
    own = table[words]
    out = np.full((len(words), 6), -1, np.int64)
    out[:, 0] = own & 4095
    far = np.flatnonzero(own >> 15)
    if len(far):
        near = np.sort(table[words[far][:, None] ^ (1 << np.arange(23))] & 4095, axis=1).astype(np.int64)
        # a neighbour list holds the own index three times and five others four times each
        first = np.ones(near.shape, bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        out[far] = near[first].reshape(len(far), 6)
    return out


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) arrays of all keys of the fingerprints."""
    fp = fp.view(np.uint64)
    a = (fp >> np.uint64(41)).astype(np.int64)
    b = (fp >> np.uint64(18) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (fp & np.uint64(0x3FFFF)).astype(np.int64)
    ka, kb = segment_keys(a), segment_keys(b)
    pair = np.where((ka[:, :, None] < 0) | (kb[:, None, :] < 0), -1, ka[:, :, None] << 12 | kb[:, None, :]).reshape(len(fp), 36)
    tag = lambda family, x: np.int64(family) << 60 | x
    held = pair >= 0
    families = [
        np.where(held, tag(1, pair << 9 | (c >> 9)[:, None]), -1),
        np.where(held, tag(2, pair << 9 | (c & 511)[:, None]), -1),
        np.where(kb >= 0, tag(3, a[:, None] << 12 | kb), -1),
        np.where(ka >= 0, tag(4, b[:, None] << 12 | ka), -1),
        tag(5, b << 18 | c)[:, None],
        tag(6, a << 18 | c)[:, None],
    ]
    all_keys = np.concatenate(families, axis=1)
    row, col = np.nonzero(all_keys >= 0)
    return row, all_keys[row, col]


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        for k in range(0, len(fp), 4096):
            part = np.ascontiguousarray(fp[k : k + 4096])
            row, key = keys(part)
            yield pa.record_batch([pa.array(key), pa.array(part[row])], names=["key", "fp"])


# ---------------------------------------------------------------- links in a bucket
class Forest:
    """Union-find over positions 0..n-1, the smallest position being the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def bucket_links(fp: np.ndarray, compare: int = COMPARE) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links (MAX_BITS or fewer) among distinct fingerprints."""
    m = len(fp)
    fp = fp.view(np.uint64)
    forest, out = Forest(m), []
    if m <= compare:
        for i in range(m - 1):
            near = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= MAX_BITS)
            for j in near.tolist():
                if forest.union(i, i + 1 + j):
                    out.append((i, i + 1 + j))
        return out
    # f and g lie within three bits if and only if a word within one bit of f lies within one bit of a word within one bit of g
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    ball = (fp[:, None] ^ flips).ravel()
    owner = np.repeat(np.arange(m), 65)
    order = np.argsort(ball, kind="stable")
    ball, owner = ball[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], ball[1:] != ball[:-1]]))
    same = np.flatnonzero(ball[1:] == ball[:-1])
    words, first = ball[head], owner[head]

    def join(x: np.ndarray, y: np.ndarray) -> None:
        pairs = np.unique(np.minimum(x, y).astype(np.int64) * m + np.maximum(x, y))
        for p in pairs.tolist():
            i, j = divmod(p, m)
            if i != j and forest.union(i, j):
                out.append((i, j))

    join(owner[same], owner[same + 1])
    for k in range(64):
        other = words ^ flips[k + 1]
        at = np.searchsorted(words, other)
        at[at == len(words)] = 0
        hit = np.flatnonzero((words[at] == other) & (other > words))
        join(first[hit], first[at[hit]])
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a bucket may go over several batches."""

    def found(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        a, b = fp[two], fp[two + 1]
        ok = np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_BITS
        left, right = [a[ok]], [b[ok]]
        for s, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist()):
            group = fp[s : s + n]
            if pairs := bucket_links(group):
                p = np.array(pairs)
                left.append(group[p[:, 0]])
                right.append(group[p[:, 1]])
        left, right = np.concatenate(left), np.concatenate(right)
        if len(left):
            pairs = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], axis=1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        key, fp = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(key):
            continue
        if held and key[-1] == held[0][0][-1] and key[0] == key[-1]:
            held.append((key, fp))
            continue
        if held:
            key = np.concatenate([*(k for k, _ in held), key])
            fp = np.concatenate([*(f for _, f in held), fp])
        last = np.searchsorted(key, key[-1])
        if last:
            yield from found(key[:last], fp[:last])
        held = [(key[last:], fp[last:])]
    if held:
        yield from found(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """Distinct fp -> (a, b): edges that connect exactly what links of MAX_BITS or fewer connect."""
    keyed = distinct.select("fp").mapInArrow(_emit_keys, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the group) for every row of docs.

    Null and blank texts have fingerprint zero and are linked like any other. Repeated rows stay repeated. A null
    doc_id is kept; it names a group only if the group has no other id. Columns other than doc_id and text are not read.
    """
    fps = cut(fingerprints(docs, width), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    parts = connected_components(link_fingerprints(distinct))
    named = (
        distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first", F.coalesce("component", "fp").alias("component"))
    )
    named = cut(named, "components")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    names = named.join(least, "component").select("fp", "component_id")
    # a fingerprint shared by very many rows is one row of names; those few are joined without a shuffle of the rows
    total = fps.count()
    floor = max(1000, total // 1000)  # at most 1,000 fingerprints are held by more rows than this
    hot = fps.groupBy("fp").count().where(F.col("count") > floor).select("fp", F.lit(True).alias("hot"))
    marked = fps.join(F.broadcast(hot), "fp", "left")
    hot_names = names.join(F.broadcast(hot.select("fp")), "fp", "left_semi")
    rest = marked.where("hot is null").join(names, "fp")
    common = marked.where("hot").join(F.broadcast(hot_names), "fp")
    out = rest.select("doc_id", "fp", "component_id").unionByName(common.select("doc_id", "fp", "component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs without those that are not the smallest doc_id of their group; of rows repeating an id, the one whose columns
    have the least hash stays.

    Shingles are of five words here. Fingerprints within three bits stand for a similarity of well over 0.8.

    Rows whose doc_id is null are kept: nothing names them.
    """
    keepers = near_duplicates(docs, width).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(keepers, "doc_id", "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns), *docs.columns)
    named = named.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null"))
