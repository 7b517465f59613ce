"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what these connect.

Candidates are texts that agree in a band of MinHash values (BANDS bands of ROWS values). A pair at similarity s is met
with probability 1 - (1 - s^ROWS)^BANDS: all but 3 in a million at 0.8, more above. Every candidate is decided by the
shingles of the two texts themselves. Equal texts are one node, so copies cost nothing.

SimHash comes first: fingerprints of the five-word shingles that tsmill.llm.simhash links at three bits or fewer are
candidates, which the shingles decide as any other. They hold nearly all pairs above 0.95 and few below, so MinHash finds
the rest.

Candidates of MinHash come in two turns. First each text of a band is compared with the band's most central text, the one whose
bands hold most texts, which connects nearly all of a group of near copies. Then the texts of each band that this has
left in different groups are compared by their sketches (a byte of each MinHash value), in blocks of BLOCK texts in a
task, however many a band holds; where sketches agree in AGREE places or more, 64-bit hashes of the shingles decide. A pair
at 0.8 agrees in fewer with a probability of 2 in a million. A task sends on the texts that have such a partner and
then links that connect them: neither turn sends on the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsmill.llm.common import connected_components, cut, drop_cut
from tsmill.llm.simhash import Forest, link_fingerprints, majority, shingle_hashes

WIDTH = 5
#: Least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 32, 5
AGREE, BLOCK = 104, 512


# ---------------------------------------------------------------- texts
def shingles(text: str | None, width: int = WIDTH) -> set[tuple]:
    """Distinct shingles of lower-cased text; a text of fewer words is one shingle, a blank one the empty shingle."""
    w = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    return set(zip(*(w[k:] for k in range(width)))) if len(w) > width else {tuple(w)}


def similar(a: set, b: set) -> bool:
    both = len(a & b)
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


@lru_cache(1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(5)
    n = BANDS * ROWS
    return r.integers(0, 1 << 64, n, np.uint64), r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def bands(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, bytes, int]:
    """The BANDS keys of a text, its sketch, and its SimHash fingerprint (without a word: 0)."""
    import xxhash

    flip, factor = _functions()
    words = (text or "").encode().lower().split()
    h = np.array(shingle_hashes(words, width), np.uint64)
    least = np.full(len(flip), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 1024):
        x = (h[k : k + 1024] ^ flip[:, None]) * factor[:, None]
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(axis=1), out=least)
    raw, size = least.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[k * size : (k + 1) * size], k) for k in range(BANDS)], np.uint64).view(np.int64), least.astype(np.uint8).tobytes(), majority(h) if words else 0


# ---------------------------------------------------------------- links
def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [bands(t) for t in b.column(2).to_pylist()]
        flat = pa.array(np.concatenate([x for x, _, _ in found]) if found else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat)
        fp = pa.array(np.array([x for _, _, x in found], np.uint64).view(np.int64))
        yield pa.record_batch([b.column(0), b.column(1), lists, pa.array([x for _, x, _ in found], pa.binary()), fp], names=["doc_id", "th", "bands", "sketch", "fp"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BANDS * ROWS)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, w) whose sketches agree enough."""
    for b in batches:
        same = (_matrix(b.column("sketch_a")) == _matrix(b.column("sketch_b"))).sum(axis=1) >= AGREE
        yield b.select(["a", "b", "w"]).filter(pa.array(same))


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one or more whole cells (key, x, y) at a time, from rows sorted by cell."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) > 2 * BLOCK:
            t = joined()
            last = int(_edges(t)[-2])
            held[:] = [t.slice(last)]
            if last:
                yield t.slice(0, last)
    if held:
        yield joined()


def _edges(t: pa.RecordBatch) -> np.ndarray:
    """Where cells begin, and the number of rows."""
    new = np.zeros(t.num_rows - 1, bool)
    for c in ("key", "x", "y"):
        v = t.column(c).to_numpy(zero_copy_only=False)
        new |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [t.num_rows]])


def _alike(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, band: int | np.ndarray) -> np.ndarray:
    """Whether pairs agree enough and agree in no band before `band`, so that each pair counts in one of its bands only."""
    same = sketch[i] == sketch[j]
    return (same.sum(axis=1) >= AGREE) & (same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band)


def cell_pairs(left: np.ndarray, right: np.ndarray, component: np.ndarray, sketch: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of a cell, i on its left and j on its right, of different components and alike."""
    li, rj = np.flatnonzero(left), np.flatnonzero(right)
    mirror = bool((left & right).any())  # a block against itself: each pair once
    out = [np.zeros((2, 0), np.int64)]
    for s in range(0, len(li), 64):
        rows = li[s : s + 64]
        apart = component[rows, None] != component[rj]
        if mirror:
            apart &= rows[:, None] < rj
        r, c = np.nonzero(apart)
        for e in range(0, len(r), 50_000):
            i, j = rows[r[e : e + 50_000]], rj[c[e : e + 50_000]]
            keep = _alike(sketch, i, j, band)
            out.append(np.stack([i[keep], j[keep]]))
    i, j = np.concatenate(out, axis=1)
    return i, j


def _columns(t: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return *(t.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right", "component", "band")), _matrix(t.column("sketch"))


def _partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of cells that are alike to another row of their cell, of another component."""
    for t in _by_cell(batches):
        left, right, component, band, sketch = _columns(t)
        edge, keep = _edges(t), np.zeros(t.num_rows, bool)
        two = edge[:-1][np.diff(edge) == 2]
        two = two[left[two] & right[two] & (component[two] != component[two + 1])]
        two = two[_alike(sketch, two, two + 1, band[two])]
        keep[two] = keep[two + 1] = True
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if e - s > 2 or not left[s] or not right[s]:
                for x in cell_pairs(left[s:e], right[s:e], component[s:e], sketch[s:e], band[s]):
                    keep[s + x] = True
        yield t.filter(pa.array(keep))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect what similar texts of a cell connect, from rows with texts."""
    for t in _by_cell(batches):
        left, right, component, band, sketch = _columns(t)
        th, text, edge = t.column("th").to_numpy(), t.column("text"), _edges(t)
        a, b = [], []
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
            i, j = cell_pairs(left[s:e], right[s:e], component[s:e], sketch[s:e], band[s])
            if not len(i):
                continue
            sets = [np.unique(np.array(shingle_hashes((x or "").encode().lower().split(), WIDTH), np.uint64)) for x in text.slice(s, e - s).to_pylist()]
            parts = Forest(e - s)
            of = {}
            for k, c in enumerate(component[s:e].tolist()):  # what the first turn has connected
                parts.union(of.setdefault(c, k), k)
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            cut_at = np.append(np.flatnonzero(np.diff(i, prepend=-1)), len(i))
            for lo, hi in zip(cut_at[:-1].tolist(), cut_at[1:].tolist()):
                mine, others = sets[i[lo]], [int(x) for x in j[lo:hi] if parts.find(int(x)) != parts.find(int(i[lo]))]
                for k in range(0, len(others), 256):
                    many = [sets[x] for x in others[k : k + 256]]
                    sizes = np.array([len(x) for x in many])
                    flat = np.concatenate(many)
                    hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                    both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                    for x in np.flatnonzero(both * LEAST[1] >= (len(mine) + sizes - both) * LEAST[0]).tolist():
                        if parts.union(int(i[lo]), others[k + x]):
                            a.append(th[s + i[lo]])
                            b.append(th[s + others[k + x]])
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that are similar, from rows a, b and their texts; rows with one a come together."""
    last, mine = None, set()
    for batch in batches:
        for s in range(0, batch.num_rows, 200):
            part, keep = batch.slice(s, 200), []
            for a, x, y in zip(*(part.column(c).to_pylist() for c in ("a", "text_a", "text_b"))):
                if a != last:
                    last, mine = a, shingles(x)
                keep.append(similar(mine, shingles(y)))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _both(pairs: DataFrame, table: DataFrame, what: str) -> DataFrame:
    """pairs (a, b, ...) with what of each."""
    right = pairs.join(table.select(F.col("th").alias("b"), F.col(what).alias(f"{what}_b")), "b")
    both = right.join(table.select(F.col("th").alias("a"), F.col(what).alias(f"{what}_a")), "a")
    return both.select(*pairs.columns, f"{what}_a", f"{what}_b")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs whose texts are similar."""
    return cut(_both(pairs, texts, "text").mapInArrow(_decide, "a long, b long"), "links")


def _cells(open_rows: DataFrame) -> DataFrame:
    """Each row of a key stands in one cell for each block of its key: with its own block and each other one."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("th"), blocks).cast("int")
    each = open_rows.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    x, y = F.least("own", "other"), F.greatest("own", "other")
    return each.select("key", x.alias("x"), y.alias("y"), (F.col("own") == x).alias("left"), (F.col("own") == y).alias("right"), "band", "th", "component", "sketch")


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """(th, fp) of different texts -> pairs (a, b) of th that connect what fingerprints within three bits connect."""
    of = prints.groupBy("fp").agg(F.min("th").alias("th"))
    same = prints.join(of.withColumnRenamed("th", "a"), "fp").where("th <> a").select("a", F.col("th").alias("b"))
    near = link_fingerprints(of).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    near = near.join(of.select(F.col("fp").alias("fa"), F.col("th").alias("a")), "fa").join(of.select(F.col("fp").alias("fb"), F.col("th").alias("b")), "fb")
    return same.unionByName(near.select("a", "b"))


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th) of every row of docs, th being the text's hash; and (node, component) of those th that have near copies."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    rows = cut(hashed.mapInArrow(_bands, "doc_id long, th long, bands array<long>, sketch binary, fp long"), "bands")
    simhash = cut(fingerprint_pairs(rows.groupBy("th").agg(F.first("fp").alias("fp"))), "pairs")
    keyed = rows.groupBy("th").agg(F.first("bands").alias("bands")).select("th", F.posexplode("bands").alias("band", "key"))
    counted = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(counted, "key"), "shared")
    sketches = cut(rows.select("th", "sketch").join(shared.select("th").distinct(), "th", "left_semi").groupBy("th").agg(F.first("sketch").alias("sketch")), "sketches")
    # all texts that may be compared: whole texts are shuffled here only, if the list of them is too long to broadcast
    compared = sketches.select("th").unionByName(simhash.select(F.explode(F.array("a", "b")).alias("th"))).distinct()
    texts = cut(hashed.select("th", "text").join(compared, "th", "left_semi").groupBy("th").agg(F.first("text").alias("text")), "texts")
    weighed = shared.select("key", "th", F.sum("n").over(Window.partitionBy("th")).alias("w"))
    central = weighed.groupBy("key").agg(F.max(F.struct("w", "th")).alias("m")).select("key", F.col("m.th").alias("a"), F.col("m.w").alias("w"))
    star = shared.join(central, "key").where("th <> a").select("a", F.col("th").alias("b"), "w").distinct()
    likely = cut(_both(star, sketches, "sketch").mapInArrow(_likely, "a long, b long, w long"), "pairs")
    # a text meets the most central of its texts first, and the others where that has left them apart
    chosen = likely.groupBy("b").agg(F.max_by("a", F.struct("w", "a")).alias("a")).select("a", "b")
    chosen = cut(chosen.unionByName(simhash).distinct(), "pairs")
    links = _verified(chosen, texts)
    parts = cut(connected_components(links).withColumnRenamed("node", "th"), "parts")
    part_of = lambda x: parts.select(F.col("th").alias(x), F.col("component").alias(f"c{x}"))
    others = likely.select("a", "b").join(chosen, ["a", "b"], "left_anti").join(part_of("a"), "a", "left").join(part_of("b"), "b", "left")
    others = cut(others.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b"), "pairs")
    links = cut(links.unionByName(_verified(others, texts)), "links")
    parts = connected_components(links).withColumnRenamed("node", "th")
    grouped = shared.join(parts, "th", "left").select("key", "n", "band", "th", F.coalesce("component", "th").alias("component"))
    open_keys = grouped.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    cells = _cells(grouped.join(open_keys, "key", "left_semi").join(sketches, "th"))
    in_order = lambda df: df.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    rest = cut(in_order(cells).mapInArrow(_partnered, cells.schema), "open")
    more = in_order(rest.join(texts, "th")).mapInArrow(_forest, "a long, b long")
    found = cut(links.unionByName(more), "links")
    components = connected_components(found)
    for t in (simhash, shared, sketches, likely, chosen, others, links, rest, texts, found):
        drop_cut(t)
    return rows.select("doc_id", "th"), components


def keep_least(docs: DataFrame) -> DataFrame:
    """docs without those that are not the smallest doc_id of their group of near copies.

    Of rows that agree in doc_id and text one stays, chosen by the hash of all columns; rows of one doc_id whose texts
    are not near copies all stay, and of near copies with one doc_id the text of least hash. So the outcome depends on
    the rows alone, not on their order. Null and blank texts are copies of each other. Rows whose doc_id is null are
    kept: nothing names them.
    """
    rows, components = near_copies(docs)
    ids = rows.where("doc_id is not null").groupBy("th").agg(F.min("doc_id").alias("doc_id"))
    grouped = ids.join(components.withColumnRenamed("node", "th"), "th", "left").withColumn("component", F.coalesce("component", "th"))
    keepers = grouped.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.th").alias("__kept"))
    named = docs.where("doc_id is not null").withColumn("__th", F.xxhash64("text"))
    kept = named.join(keepers, (F.col("doc_id") == F.col("__id")) & (F.col("__th") == F.col("__kept")), "left_semi")
    order = Window.partitionBy("doc_id", "__th").orderBy(F.xxhash64(*docs.columns), *docs.columns)
    kept = kept.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))
