"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, kept as flat arrays.

Equal vectors are one node, with their smallest ids, so that copies neither crowd a neighbourhood nor cost anything.
Nodes lie in cells around centroids, which are fitted on a bounded sample; a cell is one shard, or several where it is
large. A shard's levels are nested: level l holds its first n / FANOUT^l nodes, and each level is one (nodes, places)
array of neighbour numbers, -1 where none. Inner product is made a metric by one more component that gives all nodes
the same length. A query is searched in the shards of the cells nearest to it, as many as hold REACH of the neighbours
within the sample, and the shards' answers are merged; scores are inner products of the original vectors in double
precision. Vectors without any structure need most of the cells, others a few.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsmill.llm.common import cut, drop_cut

# shards: SHARD nodes, beyond SHARDS of these larger ones, up to VALUES components
SHARD, SHARDS, VALUES, BLOCK = 16384, 64, 1 << 23, 8192
# cells: at most CELLS for each length of vectors, from at most SAMPLE components; REACH of the neighbours are in probed cells
CELLS, SAMPLE, REACH, ASKED = 1024, 1 << 22, 0.97, 512
FANOUT, PLACES, EF_BUILD, EF_SEARCH = 16, 24, 128, 320
BATCH, EXPAND = 256, 4


# ---------------------------------------------------------------- the graph
def _first(ids: np.ndarray, ok: np.ndarray, scratch: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """ok, without later occurrences of an id in its row."""
    place = np.broadcast_to(np.arange(ids.shape[1], dtype=scratch.dtype), ids.shape)
    r = np.broadcast_to(rows[:, None], ids.shape)
    scratch[r[ok], ids[ok]] = place[ok]
    return ok & (scratch[r, np.maximum(ids, 0)] == place)


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries, ef) node numbers and inner products, best first; -1 and -inf where fewer are reached."""
    n, b = len(links), len(q)
    ids = np.full((b, ef), -1, np.int64)
    sims = np.full((b, ef), -np.inf, np.float32)
    done = np.ones((b, ef), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, np.einsum("ij,ij->i", x[entry], q), False
    seen = np.zeros((b, n), bool)
    seen[np.arange(b), entry] = True
    scratch = np.zeros((b, n), np.int16)
    active = np.arange(b)
    while len(active):
        a_sims = np.where(done[active], -np.inf, sims[active])
        top = np.argpartition(-a_sims, min(EXPAND, ef) - 1, axis=1)[:, :EXPAND]
        live = np.take_along_axis(a_sims, top, 1) > -np.inf
        go = live.any(axis=1)
        active, top, live = active[go], top[go], live[go]
        if not len(active):
            break
        r = active[:, None]
        done[r, top] = True
        near = np.where(live[:, :, None], links[np.maximum(ids[r, top], 0)], -1).reshape(len(active), -1)
        ok = (near >= 0) & ~seen[r, np.maximum(near, 0)]
        ok = _first(near, ok, scratch, active)
        seen[np.broadcast_to(r, near.shape)[ok], near[ok]] = True
        found = np.full(near.shape, -np.inf, np.float32)
        row, _ = np.nonzero(ok)
        found[ok] = np.einsum("ij,ij->i", x[near[ok]], q[active[row]])
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_sims = np.concatenate([sims[active], found], axis=1)
        all_done = np.concatenate([done[active], ~ok], axis=1)
        best = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        ids[active] = np.where(np.take_along_axis(all_sims, best, 1) > -np.inf, np.take_along_axis(all_ids, best, 1), -1)
        sims[active] = np.take_along_axis(all_sims, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1) | (ids[active] < 0)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def spread(x: np.ndarray, own: np.ndarray, cand: np.ndarray, sims: np.ndarray, places: int) -> np.ndarray:
    """Neighbours of each node among its candidates (best first): those nearer to it than to any already taken; then,
    while places are left, the best of the others."""
    b, c = cand.shape
    out = np.full((b, places), -1, np.int64)
    for s in range(0, b, 512):
        ids, sim = cand[s : s + 512], sims[s : s + 512]
        ok = (ids >= 0) & (ids != own[s : s + 512, None])
        v = x[np.maximum(ids, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        kept = np.zeros(ids.shape, bool)
        count = np.zeros(len(ids), np.int64)
        for k in range(c):
            hidden = (kept & (between[:, k] > sim[:, k, None])).any(axis=1)
            kept[:, k] = ok[:, k] & ~hidden & (count < places)
            count += kept[:, k]
        rank = np.where(kept, 0, np.where(ok, 1, 2)) * c + np.arange(c)
        order = np.argsort(rank, axis=1)[:, :places]
        chosen = np.where(np.take_along_axis(rank, order, 1) < 2 * c, np.take_along_axis(ids, order, 1), -1)
        out[s : s + 512, : chosen.shape[1]] = chosen
    return out


def _ranked(ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _link(x: np.ndarray, links: np.ndarray, new: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> None:
    """Give the new nodes neighbours and their neighbours the way back."""
    places = links.shape[1]
    chosen = spread(x, new, cand, sims, max(1, places // 2))
    links[new, : chosen.shape[1]] = chosen
    src, dst = np.repeat(new, chosen.shape[1]), chosen.ravel()
    ok = dst >= 0
    src, dst = src[ok], dst[ok]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    nodes, start, size = np.unique(dst, return_index=True, return_counts=True)
    for lo in range(0, int(size.max(initial=0)), places):  # very popular nodes take their callers in turns
        part = np.flatnonzero(size > lo)
        width = int(min(places, size[part].max() - lo))
        at = start[part, None] + lo + np.arange(width)
        inside = np.arange(width) + lo < size[part, None]
        callers = np.where(inside, src[np.minimum(at, len(src) - 1)], -1)
        old = links[nodes[part]]
        callers = np.where((callers[:, :, None] == old[:, None, :]).any(axis=2), -1, callers)
        ids = np.concatenate([old, callers], axis=1)
        s = np.where(ids >= 0, np.einsum("ijk,ik->ij", x[np.maximum(ids, 0)], x[nodes[part]]), -np.inf)
        ids, s = _ranked(ids, s, ids.shape[1])
        full = (ids >= 0).sum(axis=1) > places
        links[nodes[part[~full]]] = ids[~full][:, :places]
        if full.any():
            links[nodes[part[full]]] = spread(x, nodes[part[full]], ids[full], s[full], places)


def build(vectors: np.ndarray) -> list[np.ndarray]:
    """Neighbour arrays of the levels, the highest first. Nodes are numbered as they come, which must be at random."""
    x = metric(vectors)
    sizes = [len(x)]
    while sizes[-1] > 4 * FANOUT:
        sizes.append(sizes[-1] // FANOUT)
    levels: list[np.ndarray] = []
    for n in reversed(sizes):
        places = PLACES * (2 if n == len(x) else 1)
        links = np.full((n, places), -1, np.int64)
        first = min(n, max(len(levels[-1]) if levels else n, 1))
        # nodes of the level above are compared outright, the others are inserted in batches
        for s in range(0, first, BATCH):
            new = np.arange(s, min(first, s + BATCH))
            sims = x[new] @ x[:first].T
            sims[np.arange(len(new)), new] = -np.inf
            cand, top = _ranked(np.broadcast_to(np.arange(first), sims.shape), sims, EF_BUILD)
            _link(x, links, new, np.where(top > -np.inf, cand, -1), top)
        for s in range(first, n, BATCH):
            new = np.arange(s, min(n, s + BATCH))
            cand, sims = beam(x, links, x[new], descend(x, levels, x[new]), EF_BUILD)
            mates = x[new] @ x[new].T
            mates[np.arange(len(new)), np.arange(len(new))] = -np.inf
            cand = np.concatenate([cand, np.broadcast_to(new, mates.shape)], axis=1)
            cand, sims = _ranked(cand, np.concatenate([sims, mates], axis=1), EF_BUILD)
            _link(x, links, new, np.where(sims > -np.inf, cand, -1), sims)
        levels.append(links)
    return levels


def descend(x: np.ndarray, levels: list[np.ndarray], q: np.ndarray) -> np.ndarray:
    entry = np.zeros(len(q), np.int64)
    for links in levels:
        entry = beam(x, links, q, entry, 8)[0][:, 0]
    return entry


def metric(vectors: np.ndarray) -> np.ndarray:
    """Vectors with a component more, all of one length: the largest inner product is then the nearest."""
    v = vectors / max(1e-300, np.abs(vectors).max(initial=0))
    square = (v * v).sum(axis=1)
    rest = np.sqrt(np.maximum(square.max(initial=0) - square, 0))
    return np.concatenate([v, rest[:, None]], axis=1).astype(np.float32)


def search(vectors: np.ndarray, levels: list[np.ndarray], queries: np.ndarray, most: int, ef: int = EF_SEARCH) -> np.ndarray:
    """(queries, most) node numbers, best first; -1 where fewer."""
    x = metric(vectors)
    out = np.full((len(queries), most), -1, np.int64)
    scale = np.maximum(np.abs(queries).max(axis=1, keepdims=True, initial=0), 1e-300)
    q = np.concatenate([queries / scale, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    for s in range(0, len(q), BATCH):
        part = q[s : s + BATCH]
        ids, _ = beam(x, levels[-1], part, descend(x, levels[:-1], part), max(ef, most))
        out[s : s + BATCH] = ids[:, :most]
    return out


# ---------------------------------------------------------------- cells
class Cells(NamedTuple):
    """Centroids of one length of vectors, how many cells a query visits and the longest vector."""

    centroids: np.ndarray
    probes: int
    longest: float


def lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of length 1 that keep the order of inner products."""
    u = v / longest
    rest = np.sqrt(np.maximum(1 - (u * u).sum(axis=1), 0))
    return np.concatenate([u, rest[:, None]], axis=1).astype(np.float32)


def cell_of(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[s : s + 4096] @ centroids.T).argmax(axis=1) for s in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def cell_order(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(queries, cells): cells by the inner product of query and centroid, best first."""
    scale = np.maximum(np.abs(q).max(axis=1, keepdims=True, initial=0), 1e-300)
    return np.argsort(-((q / scale).astype(np.float32) @ centroids[:, :-1].T), axis=1, kind="stable")


def fit_cells(v: np.ndarray, cells: int, longest: float, near: int, rounds: int = 10) -> Cells:
    """Spherical k-means of a sample in random order, and the fewest probes that reach REACH of the `near` nearest
    neighbours which ASKED vectors of the sample have within it."""
    x = lifted(v, longest)
    c = x[:cells].copy()
    for _ in range(rounds):
        own = cell_of(x, c)
        order = np.argsort(own, kind="stable")
        filled, start = np.unique(own[order], return_index=True)
        total = np.add.reduceat(x[order], start, axis=0)
        c[filled] = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-30)
    own, q = cell_of(x, c), v[:ASKED]
    place = np.argsort(cell_order(q, c), axis=1)
    ranks = []
    for i in range(len(q)):
        sims = x[:, :-1] @ (q[i] / longest).astype(np.float32)
        sims[i] = -np.inf
        ranks.append(place[i, own[np.argpartition(-sims, near - 1)[:near]]])
    share = np.cumsum(np.bincount(np.concatenate(ranks), minlength=cells)) / (len(q) * near)
    return Cells(c, int(np.searchsorted(share, REACH)) + 1, longest)


def _groups(batch: pa.RecordBatch):
    """(length, row numbers, vectors) for each length of vectors in a batch with a column v."""
    v = batch.column("v")
    starts = v.offsets.to_numpy()
    flat, lengths = v.values.to_numpy(zero_copy_only=False), np.diff(starts)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield int(dim), rows, flat[starts[rows, None] + np.arange(dim)]


# ---------------------------------------------------------------- tables
def usable(table: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Distinct (id, v: array<double>) of rows whose vector is neither null, empty, zero nor holds a null or non-finite component."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.select(F.col(ident).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(finite & F.exists("v", lambda c: c != 0)).distinct()


def fit(nodes: DataFrame, k: int, shard: int | None) -> tuple[dict[int, Cells], dict[int, int]]:
    """Cells and nodes a shard, by length of vectors. A sample of SAMPLE components at most of each length reaches the driver."""

    def measure(batches):
        for batch in batches:
            for dim, at, v in _groups(batch):
                most = np.abs(v).max(axis=1)
                longest = (most * np.sqrt(((v / most[:, None]) ** 2).sum(axis=1))).max()
                yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([len(at)], pa.int64()), pa.array([min(longest, 1.7e308)])], ["dim", "n", "longest"])

    parts = nodes.select("v").mapInArrow(measure, "dim int, n long, longest double")
    stats = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.max("longest").alias("longest")).collect()
    models, sizes = {}, {}
    for dim, n, longest in stats:
        sizes[dim] = shard or min(max(SHARD // 8, VALUES // dim), max(SHARD, n // SHARDS))
        rows = min(n, max(1024, SAMPLE // dim))
        cells = max(1, min(CELLS, round(n / sizes[dim]), rows // 32))
        if cells == 1:
            models[dim] = Cells(np.zeros((1, dim + 1), np.float32), 1, longest)
            continue
        some = nodes.select("v", "h").where(F.size("v") == dim).where(F.pmod("h", F.lit(1 << 30)) < int(min(1, 1.2 * rows / n) * (1 << 30)))
        sample = some.orderBy("h").limit(rows).select("v").toArrow().column("v").combine_chunks()
        v = sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        models[dim] = fit_cells(v, cells, longest, min(len(v) - 1, max(1, round(k * len(v) / n))))
    return models, sizes


def index(rows: DataFrame, most: int, shard: int | None = None) -> tuple[DataFrame, dict[int, tuple[Cells, np.ndarray, np.ndarray, np.ndarray]]]:
    """One row for each shard: its vectors, level arrays and, for each node, its `most` smallest ids. With it, for each
    length of vectors, the cells and each cell's nodes, first shard and number of shards."""
    order = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)  # the rest of a class can never rank
    nodes = cut(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("h", F.xxhash64(F.lit("order"), "v")), "nodes")
    models, sizes = fit(nodes, most - 1, shard)

    def place(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for dim, at, v in _groups(batch):
                model = models[dim]
                if len(model.centroids) > 1:
                    cell[at] = cell_of(lifted(v, model.longest), model.centroids)
            yield batch.append_column("cell", pa.array(cell))

    placed = cut(nodes.mapInArrow(place, "v array<double>, ids array<long>, h long, cell int"), "placed")
    found = placed.groupBy(F.size("v").alias("dim"), "cell").agg(F.count("*").alias("n")).collect()  # CELLS a length at most
    plan, table = {}, []
    for dim, model in models.items():
        held = np.zeros(len(model.centroids), np.int64)
        for r in found:
            if r["dim"] == dim:
                held[r["cell"]] = r["n"]
        parts = np.where(held > 0, np.maximum(1, np.round(held / sizes[dim])), 0).astype(np.int64)
        first = np.cumsum(parts) - parts
        plan[dim] = (model, held, first, parts)
        table += [(dim, i, int(first[i]), int(parts[i])) for i in range(len(held)) if parts[i]]
    shards = F.broadcast(rows.sparkSession.createDataFrame(table, "dim int, cell int, first int, parts int"))
    dealt = placed.withColumn("dim", F.size("v")).join(shards, ["dim", "cell"])
    dealt = dealt.select("dim", (F.col("first") + F.pmod("h", "parts").cast("int")).alias("shard"), "v", "ids", "h")

    def make(key, table):
        dim = key[0].as_py()
        table = table.sort_by([("h", "ascending")])
        vectors = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        levels = build(vectors)
        ids = table.column("ids").combine_chunks()
        lengths = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        return pa.table({
            "dim": pa.array([dim], pa.int32()),
            "shard": pa.array([key[1].as_py()], pa.int32()),
            "vectors": pa.array([vectors.astype(np.float64).tobytes()], pa.binary()),
            "widths": pa.array([[a.shape[1] for a in levels]], pa.list_(pa.int32())),
            "levels": pa.array([[a.astype(np.int32).tobytes() for a in levels]], pa.list_(pa.binary())),
            "lengths": pa.array([lengths.astype(np.int32).tobytes()], pa.binary()),
            "ids": pa.array([ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()),
        })

    made = dealt.groupBy("dim", "shard").applyInArrow(make, "dim int, shard int, vectors binary, widths array<int>, levels array<binary>, lengths binary, ids binary")
    out = cut(made, "index")
    drop_cut(nodes)
    drop_cut(placed)
    return out, plan


def routed(asked: DataFrame, plan: dict, least: int) -> DataFrame:
    """asked (id, v) once for each shard to be searched: those of the nearest cells, which hold `least` nodes or all."""

    def visit(batches):
        for batch in batches:
            rows, shards = [], []
            for dim, at, v in _groups(batch):
                model, held, first, parts = plan[dim]
                order = cell_order(v, model.centroids)
                before = np.cumsum(held[order], axis=1) - held[order]
                go = (np.arange(order.shape[1]) < model.probes) | (before < least)
                i, j = np.nonzero(go)
                cell = order[i, j]
                many = parts[cell]
                rows.append(np.repeat(at[i], many))
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                shards.append(np.repeat(first[cell], many) + within)
            if rows:
                yield batch.take(pa.array(np.concatenate(rows))).append_column("shard", pa.array(np.concatenate(shards).astype(np.int32)))

    return asked.select("id", "v").mapInArrow(visit, "id long, v array<double>, shard int")


def nearest(table: DataFrame, k: int = 20, modulus: int = 20, ident: str = "vec_id", vector: str = "embedding", shard: int | None = None, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by modulus, the k nearest other rows found.

    Only vectors of equal length are compared. Rows that repeat both id and vector are one; an id with several vectors
    is several candidates and several queries, none of which finds its own id. Rows with a null id or an unusable vector
    take no part. Ties in score go to the smaller id. Only the columns of ids and vectors are read, so others may have
    any name. An empty table gives no rows. shard: nodes a shard, None for the rule of this module.
    """
    rows = cut(usable(table, ident, vector), "vectors")
    shards, plan = index(rows, k + 1, shard)
    asked = routed(rows.where(F.col("id") % modulus == 0), plan, 2 * (k + 1))
    asked = asked.select(F.size("v").alias("dim"), "shard", "id", "v", F.xxhash64("v").alias("qh"))
    loads = asked.groupBy("dim", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    key = ["dim", "shard", "block"]
    spread_out = shards.join(loads, ["dim", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = asked.join(loads, ["dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("v", "id"), "blocks").cast("int")).drop("blocks")

    def find(key, left, right):
        none = pa.table({"query_id": pa.array([], pa.int64()), "qh": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        s = left.to_pylist()[0]
        dim = s["dim"]
        vectors = np.frombuffer(s["vectors"], np.float64).reshape(-1, dim)
        levels = [np.frombuffer(b, np.int32).reshape(-1, w).astype(np.int64) for b, w in zip(s["levels"], s["widths"])]
        lengths = np.frombuffer(s["lengths"], np.int32)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.frombuffer(s["ids"], np.int64)
        q_ids, q_hashes = right.column("id").to_pylist(), right.column("qh").to_pylist()
        q = right.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        found = search(vectors, levels, q, min(len(vectors), max(2 * k, k + 1)), max(ef, 2 * k))
        out_q, out_h, out_id, out_score = [], [], [], []
        for i, own in enumerate(q_ids):
            nodes = found[i][found[i] >= 0]
            score = (vectors[nodes] * q[i]).sum(axis=1)
            member = np.concatenate([ids[starts[m] : starts[m + 1]] for m in nodes])
            score = np.repeat(score, lengths[nodes])
            keep = member != own
            member, score = member[keep], score[keep]
            best = np.lexsort((member, -score))[:k]
            out_q.append(np.full(len(best), own))
            out_h.append(np.full(len(best), q_hashes[i]))
            out_id.append(member[best])
            out_score.append(score[best])
        return pa.table({"query_id": np.concatenate(out_q), "qh": np.concatenate(out_h), "vec_id": np.concatenate(out_id), "score": np.concatenate(out_score)})

    hits = spread_out.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(find, "query_id long, qh long, vec_id long, score double")
    order = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
