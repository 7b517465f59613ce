"""Sketches built by grouped counts: percentiles (uddsketch, tdigest), distinct counts, frequent values, item counts.

Each builder takes a frame and key columns and gives one row for each group with a struct column. Counting is done by
native aggregates with partial aggregation; only bounded sketches are collected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tsmill.functions.base import ColumnLike, col, let, need, own_keys


def _by(df: DataFrame, keys: list[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


# ---------------------------------------------------------------- uddsketch
def _alpha(alpha: float, compactions: Column) -> Column:
    """Error after a number of compactions, each making a of it 2a / (1 + a^2)."""
    return F.aggregate(F.sequence(F.lit(0), compactions), F.lit(-1.0), lambda a, i: F.when(i == 0, F.lit(float(alpha))).otherwise(a * 2 / (1 + a * a)))


def _compacted(idx: Column, by: Column) -> Column:
    """Buckets after compactions: two neighbours become one each time, ceil(k / 2)."""
    return F.ceil(idx / F.pow(F.lit(2.0), by)).cast("long")


#: Codes of buckets: sign * (idx + _MIDDLE), in the order of values. Of finite values idx lies within 2^49 of 0; that of an
#: infinity, the largest long, is held as _FAR. Unlike structs, longs are hashed and sorted in linear time or nearly so.
_MIDDLE, _FAR = 1 << 61, 1 << 60


def _code(sign: Column, idx: Column) -> Column:
    return sign * (F.greatest(F.least(idx, F.lit(_FAR)), F.lit(-_FAR)) + _MIDDLE)


def _compacted_code(code: Column, by: Column | int) -> Column:
    k = _compacted(F.abs(code) - _MIDDLE, by if isinstance(by, Column) else F.lit(by)) + _MIDDLE
    return F.when(code < 0, -k).when(code > 0, k).otherwise(code)


def _sign_idx(code: Column, c: Column) -> tuple[Column, Column]:
    """Sign and idx of a code after c compactions."""
    idx = F.abs(code) - _MIDDLE
    far = idx * F.pow(F.lit(2.0), c) > float(1 << 50)
    return F.signum(code).cast("int"), F.when(code == 0, F.lit(0).cast("long")).when(far, _compacted(F.lit((1 << 63) - 1), c)).otherwise(idx)


def _code_levels(codes: Column, size: int) -> Column:
    """The least number of compactions after which at most `size` codes are left, each taken from what the last one left."""
    level = lambda c, k: F.struct(c.alias("c"), F.array_distinct(k).alias("k"))
    more = lambda a, _: F.when(F.size(a["k"]) <= size, a).otherwise(level(a["c"] + 1, F.transform(a["k"], lambda x: _compacted_code(x, 1))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), level(F.lit(0), codes), more, lambda a: F.when(F.size(a["k"]) <= size, a["c"]).otherwise(-1))


def _levels(buckets: Column, size: int) -> Column:
    """The least number of compactions after which at most `size` buckets are left."""
    return _code_levels(F.transform(buckets, lambda b: _code(b["sign"], b["idx"])), size)


def _finish(grouped: DataFrame, keys: list[str], size: int, error: float, name: str) -> DataFrame:
    """grouped: keys, sign, idx, n, total for each bucket, and c, the compactions so far, if there were any."""
    if "c" in grouped.columns:
        most = F.max("c").over(Window.partitionBy(*(keys or [F.lit(0)])))
    else:  # nothing has been compacted yet
        grouped, most = grouped.withColumn("c", F.lit(0)), F.lit(0)
    level = grouped.withColumn("most", most).withColumn("idx", _compacted(F.col("idx"), F.col("most") - F.col("c")))
    level = level.groupBy(*keys, "sign", "idx", "most").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    listed = _by(level, keys).agg(F.max("most").alias("most"), F.collect_list(F.struct("sign", "idx", "n", "total")).alias("b"))
    more = listed.withColumn("more", _levels(F.col("b"), size)).select(*keys, "most", "more", F.explode("b").alias("b"))
    final = more.groupBy(*keys, F.col("b.sign").alias("sign"), _compacted(F.col("b.idx"), F.col("more")).alias("idx"), (F.col("most") + F.col("more")).alias("c")).agg(
        F.sum("b.n").alias("n"), F.sum("b.total").alias("total")
    )
    # order: negative values with the largest first, zero, positive values
    order = F.array_sort(F.collect_list(F.struct((F.col("sign") * F.col("idx")).alias("k"), "sign", "idx", "n")), lambda a, b: F.when(a["sign"] != b["sign"], a["sign"] - b["sign"]).when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    out = _by(final, keys).agg(F.max("c").cast("int").alias("c"), F.sum("n").alias("count"), F.sum("total").alias("sum"), order.alias("b"))
    buckets = F.transform("b", lambda b: F.struct(b["sign"].alias("sign"), b["idx"].alias("idx"), b["n"].alias("n")))
    sketch = F.struct(_alpha(error, F.col("c")).alias("alpha"), F.lit(float(error)).alias("error"), F.lit(size).alias("size"), F.col("c").alias("compactions"), "count", "sum", buckets.alias("buckets"))
    return out.where("count > 0").select(*keys, sketch.alias(name))


@own_keys
def uddsketch(df: DataFrame, keys: list[str], value: str, size: int, max_error: float, name: str = "sketch") -> DataFrame:
    """Percentile sketch of at most `size` buckets; relative error max_error, more after each compaction. Independent of
    the order of rows. Nulls are left out."""
    need(1e-12 <= max_error < 1, "max_error must lie in [1e-12, 1)")
    need(size > 0, "size must be positive")
    log_gamma = math.log((1 + max_error) / (1 - max_error))
    v = F.col(value).cast("double")
    idx = F.when(v == 0, F.lit(0)).otherwise(F.ceil(F.ln(F.abs(v)) / F.lit(log_gamma))).cast("long")
    sign = F.when(v > 0, 1).when(v < 0, -1).otherwise(0)
    rows = df.where(v.isNotNull()).select(*keys, sign.alias("sign"), idx.alias("idx"), v.alias("v"))
    grouped = rows.groupBy(*keys, "sign", "idx").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    return _finish(grouped, keys, size, max_error, name)


def percentile_agg(df: DataFrame, keys: list[str], value: str, name: str = "sketch") -> DataFrame:
    return uddsketch(df, keys, value, 200, 0.001, name)


@own_keys
def rollup_uddsketch(df: DataFrame, keys: list[str], sketch: str, size: int, max_error: float, name: str = "sketch") -> DataFrame:
    """Merge sketches of this size and error, others being an error; the coarsest decides where to begin."""
    s = F.col(sketch)
    unlike = (s["error"] != F.lit(float(max_error))) | (s["size"] != size)
    c = F.when(unlike, F.raise_error(F.lit("sketches of another size or error cannot be merged")).cast("int")).otherwise(s["compactions"])
    part = df.where(s.isNotNull()).select(*keys, c.alias("c"), s["sum"].alias("sum"), s["count"].alias("count"), F.explode(s["buckets"]).alias("b"))
    # each bucket takes its share of the sum, so that the total comes out
    share = F.col("sum") * F.col("b.n") / F.col("count")
    grouped = part.groupBy(*keys, F.col("b.sign").alias("sign"), F.col("b.idx").alias("idx"), "c").agg(F.sum("b.n").alias("n"), F.sum(share).alias("total"))
    return _finish(grouped, keys, size, max_error, name)


def _bucket_value(s: Column, b: Column) -> Column:
    gamma = (1 + s["alpha"]) / (1 - s["alpha"])
    return F.when(b["sign"] == 0, F.lit(0.0)).otherwise(b["sign"] * F.pow(gamma, (b["idx"] - 1).cast("double")) * (1 + s["alpha"]))


def udd_percentile(s: ColumnLike, p) -> Column:
    """Estimate of the p-quantile."""

    def find(s: Column) -> Column:
        want = F.floor(s["count"] * F.lit(p)).cast("long") + 1
        hit = F.aggregate(
            s["buckets"],
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("struct<sign: int, idx: long, n: long>").alias("b")),
            lambda a, b: F.struct((a["seen"] + b["n"]).alias("seen"), F.when(a["b"].isNull() & (a["seen"] + b["n"] >= want), b).otherwise(a["b"]).alias("b")),
        )
        return F.when(want >= s["count"], _bucket_value(s, F.element_at(s["buckets"], -1))).otherwise(let(hit["b"], lambda b: _bucket_value(s, b)))

    return let(col(s), find)


def udd_percentile_array(s: ColumnLike, ps: list[float]) -> Column:
    return F.array(*(udd_percentile(s, p) for p in ps))


def udd_percentile_rank(s: ColumnLike, v: float) -> Column:
    """Share of values below v: those of lower buckets and half of v's own."""

    def find(s: Column) -> Column:
        gamma = (1 + s["alpha"]) / (1 - s["alpha"])
        sign = F.lit(0 if v == 0 else 1 if v > 0 else -1)
        idx = F.ceil(F.lit(math.log(abs(v)) if v else 0.0) / F.ln(gamma)).cast("long") if v else F.lit(0).cast("long")
        own = lambda b: (b["sign"] == sign) & (b["idx"] == idx)
        below = lambda b: (b["sign"] < sign) | ((b["sign"] == sign) & (b["sign"] * b["idx"] < sign * idx))
        part = F.aggregate(s["buckets"], F.lit(0.0), lambda a, b: a + F.when(own(b), b["n"] / 2).when(below(b), b["n"].cast("double")).otherwise(0.0))
        return part / s["count"]

    return let(col(s), find)


def udd_error(s: ColumnLike) -> Column:
    return col(s)["alpha"]


# shared by uddsketch and tdigest
def mean(s: ColumnLike) -> Column:
    return col(s)["sum"] / col(s)["count"]


def num_vals(s: ColumnLike) -> Column:
    return col(s)["count"]


def total(s: ColumnLike) -> Column:
    return col(s)["sum"]


# ---------------------------------------------------------------- tdigest
def _limit(k: float, size: int) -> float:
    x = k / size
    return 2 * x * x if x < 0.5 else 1 - 2 * (1 - x) ** 2


def cluster(means: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of sorted means: the k-th ends where the weight reaches the k-th limit of a quadratic scale."""
    seen = np.cumsum(weights)
    n, start, k, cuts = seen[-1] if len(seen) else 0, 0, 1.0, []
    while start < len(means):
        end = max(start + 1, int(np.searchsorted(seen, _limit(k, size) * n, side="right")))
        cuts.append(start)
        start, k = end, min(k + 1.0, float(size))
    at = np.array(cuts, np.int64)
    w = np.add.reduceat(weights, at) if len(at) else weights
    return (np.add.reduceat(means * weights, at) / w if len(at) else means), w


DIGEST = StructType([
    StructField("size", LongType()), StructField("count", LongType()), StructField("sum", DoubleType()), StructField("min", DoubleType()), StructField("max", DoubleType()),
    StructField("centroids", ArrayType(StructType([StructField("mean", DoubleType()), StructField("weight", LongType())]))),
])


def _digest_table(keys: list[str], table: pa.Table, rows: list[tuple]) -> pa.Table:
    columns = {k: table.column(k).slice(0, 1).combine_chunks() for k in keys}
    return pa.table({**columns, "d": pa.array([r for r in rows], pa.struct([("size", pa.int64()), ("count", pa.int64()), ("sum", pa.float64()), ("min", pa.float64()), ("max", pa.float64()), ("centroids", pa.list_(pa.struct([("mean", pa.float64()), ("weight", pa.int64())])))]))})


@own_keys
def tdigest(df: DataFrame, keys: list[str], value: str, size: int, name: str = "sketch", part_rows: int = 100_000) -> DataFrame:
    """Percentile digest of about `size` centroids. Nulls and NaN are left out.

    Equal values are counted first. Values are cut into parts of about part_rows distinct ones by hash, each part is
    digested on its own and the digests are merged, so no task holds a large group and the order of rows does not matter.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, (v + F.lit(0.0)).alias("__v")).groupBy(*keys, "__v").agg(F.count("*").alias("__w"))
    sized = rows.groupBy(*keys).agg(F.count("*").alias("__n")) if keys else rows.agg(F.count("*").alias("__n"))
    crowded = sized.where(F.col("__n") > part_rows)  # at most rows / part_rows groups
    parts = crowded.select(*keys, F.ceil(F.col("__n") / part_rows).cast("int").alias("__parts"))
    joined = rows.join(parts, keys, "left") if keys else rows.crossJoin(F.broadcast(sized.select(F.ceil(F.col("__n") / part_rows).cast("int").alias("__parts"))))
    dealt = joined.withColumn("__part", F.pmod(F.xxhash64("__v"), F.coalesce("__parts", F.lit(1)))).drop("__parts")
    schema = StructType([*(rows.schema[k] for k in keys), StructField("d", DIGEST)])

    def build(table):
        table = table.sort_by("__v")
        x, n = table.column("__v").to_numpy(), table.column("__w").to_numpy()
        m, w = cluster(x, n, size)
        c = [{"mean": a, "weight": b} for a, b in zip(m.tolist(), w.tolist())]
        return _digest_table(keys, table, [{"size": size, "count": int(n.sum()), "sum": float((x * n).sum()), "min": float(x[0]), "max": float(x[-1]), "centroids": c}])

    digests = dealt.groupBy(*keys, "__part").applyInArrow(build, schema)
    return rollup_tdigest(digests, keys, "d", size, name)


@own_keys
def rollup_tdigest(df: DataFrame, keys: list[str], sketch: str, size: int, name: str = "sketch") -> DataFrame:
    """Merge digests; all centroids of all of them are clustered anew."""
    rows = df.where(F.col(sketch).isNotNull()).select(*keys, F.col(sketch).alias("d"))
    schema = StructType([*(rows.schema[k] for k in keys), StructField("d", DIGEST)])

    def merge(table):
        d = sorted(table.column("d").to_pylist(), key=repr)  # sums do not depend on how digests arrive
        if len(d) == 1:
            return _digest_table(keys, table, d)
        m = np.array([c["mean"] for x in d for c in x["centroids"]])
        w = np.array([c["weight"] for x in d for c in x["centroids"]], np.int64)
        order = np.argsort(m, kind="stable")
        m, w = cluster(m[order], w[order], size)
        c = [{"mean": a, "weight": b} for a, b in zip(m.tolist(), w.tolist())]
        return _digest_table(keys, table, [{"size": size, "count": int(w.sum()), "sum": sum(x["sum"] for x in d), "min": min(x["min"] for x in d), "max": max(x["max"] for x in d), "centroids": c}])

    return rows.groupBy(*keys).applyInArrow(merge, schema).select(*keys, F.col("d").alias(name))


def _between(m1: Column, w1: Column, m2: Column, w2: Column) -> Column:
    """Mean of two means by weight, which lies between them."""
    return F.greatest(F.least(m1, m2), F.least(F.greatest(m1, m2), (m1 * w1 + m2 * w2) / (w1 + w2)))


def tdigest_percentile(s: ColumnLike, p: float) -> Column:
    """Estimate of the p-quantile, on lines between the centroids' means and the points between them."""

    def find(s: Column) -> Column:
        c, n = s["centroids"], F.size(s["centroids"])
        rank = F.lit(float(p)) * s["count"]
        zero = F.lit(0).cast("long")
        walk = F.aggregate(
            c,
            F.struct(F.lit(-1).alias("pos"), zero.alias("t"), zero.alias("seen"), F.lit(0).alias("i")),
            lambda a, x: F.struct(
                F.when((a["seen"] <= rank) if p > 0.5 else ((a["pos"] < 0) & (rank < a["seen"] + x["weight"])), a["i"]).otherwise(a["pos"]).alias("pos"),
                F.when((a["seen"] <= rank) if p > 0.5 else ((a["pos"] < 0) & (rank < a["seen"] + x["weight"])), a["seen"]).otherwise(a["t"]).alias("t"),
                (a["seen"] + x["weight"]).alias("seen"),
                (a["i"] + 1).alias("i"),
            ),
        )

        def at(w: Column) -> Column:
            pos = F.when(w["pos"] < 0, n - 1).otherwise(w["pos"])
            here, before, after = F.get(c, pos), F.get(c, pos - 1), F.get(c, pos + 1)
            share = (rank - w["t"]) / here["weight"]
            lower = _between(F.coalesce(before["mean"], s["min"]), F.coalesce(before["weight"], zero), here["mean"], here["weight"])
            upper = _between(here["mean"], here["weight"], F.coalesce(after["mean"], s["max"]), F.coalesce(after["weight"], zero))
            return F.when(share < 0.5, lower + (here["mean"] - lower) * share * 2).otherwise(here["mean"] + (upper - here["mean"]) * (share - 0.5) * 2)

        inner = let(walk, at)
        if p >= 1:
            return s["max"]
        if p <= 0:
            return s["min"]
        return inner if p > 0.5 else F.when(rank <= 1, s["min"]).otherwise(inner)

    return let(col(s), find)


def tdigest_percentile_rank(s: ColumnLike, v: float) -> Column:
    """Estimate of the share of values up to v."""

    def find(s: Column) -> Column:
        x, zero = F.lit(float(v)), F.lit(0).cast("long")
        start = F.struct(s["min"].alias("lo"), zero.alias("lw"), s["max"].alias("hi"), zero.alias("hw"), zero.alias("seen"), F.lit(False).alias("found"))
        walk = F.aggregate(
            s["centroids"],
            start,
            lambda a, c: F.when(a["found"], a)
            .when(x < c["mean"], F.struct(a["lo"].alias("lo"), a["lw"].alias("lw"), c["mean"].alias("hi"), c["weight"].alias("hw"), a["seen"].alias("seen"), F.lit(True).alias("found")))
            .otherwise(F.struct(c["mean"].alias("lo"), c["weight"].alias("lw"), a["hi"].alias("hi"), a["hw"].alias("hw"), (a["seen"] + c["weight"]).alias("seen"), F.lit(False).alias("found"))),
        )

        def at(w: Column) -> Column:
            mid = w["lo"] + (w["hi"] - w["lo"]) * w["lw"] / F.greatest(w["lw"] + w["hw"], F.lit(1).cast("long"))
            up = w["seen"] + F.coalesce((x - mid) / F.when(w["hi"] != mid, w["hi"] - mid), F.lit(0.0)) * w["hw"] / 2
            down = w["seen"] - F.coalesce((mid - x) / F.when(mid != w["lo"], mid - w["lo"]), F.lit(0.0)) * w["lw"] / 2
            return F.when(x > mid, up).otherwise(down) / s["count"]

        return F.when(x < s["min"], 0.0).when(x > s["max"], 1.0).otherwise(let(walk, at))

    return let(col(s), find)


def min_val(s: ColumnLike) -> Column:
    return col(s)["min"]


def max_val(s: ColumnLike) -> Column:
    return col(s)["max"]


# ---------------------------------------------------------------- hyperloglog
def _precision(size: int) -> int:
    need(size > 0, "size must be positive")
    p = max(4, (size - 1).bit_length())
    need(p <= 18, "size must be at most 262144")
    return p


@own_keys
def hyperloglog(df: DataFrame, keys: list[str], value: str, size: int, name: str = "sketch") -> DataFrame:
    """Distinct-count sketch of any column; size is raised to a power of two in 16 .. 262144. Nulls are left out."""
    p = _precision(size)
    h = F.xxhash64(F.col(value))
    rest = h.bitwiseAND(F.lit((1 << (64 - p)) - 1))
    rho = F.when(rest == 0, 64 - p + 1).otherwise(64 - p - F.length(F.bin(rest)) + 1)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.shiftrightunsigned(h, 64 - p).cast("int").alias("i"), rho.cast("int").alias("r"))
    return _registers(rows, keys, p, name)


def approx_count_distinct(df: DataFrame, keys: list[str], value: str, name: str = "sketch") -> DataFrame:
    return hyperloglog(df, keys, value, 32768, name)


def _registers(rows: DataFrame, keys: list[str], p: int, name: str) -> DataFrame:
    best = rows.groupBy(*keys, "i").agg(F.max("r").alias("r"))
    sketch = F.struct(F.lit(p).alias("precision"), F.sort_array(F.collect_list(F.struct("i", "r"))).alias("registers"))
    return _by(best, keys).agg(sketch.alias(name))


@own_keys
def rollup_hyperloglog(df: DataFrame, keys: list[str], sketch: str, name: str = "sketch") -> DataFrame:
    """Union of sketches of one precision."""
    s = F.col(sketch)
    rows = df.select(*keys, s["precision"].alias("p"), F.explode(s["registers"]).alias("x")).select(*keys, "p", F.col("x.i").alias("i"), F.col("x.r").alias("r"))
    best = rows.groupBy(*keys, "i").agg(F.max("r").alias("r"), F.min("p").alias("p"), F.max("p").alias("q"))
    p = F.when(F.min("p") == F.max("q"), F.min("p")).otherwise(F.raise_error(F.lit("sketches differ in precision")).cast("int"))
    return _by(best, keys).agg(F.struct(p.alias("precision"), F.sort_array(F.collect_list(F.struct("i", "r"))).alias("registers")).alias(name))


def distinct_count(s: ColumnLike) -> Column:
    """Estimated number of distinct values, from how many registers hold each rank (no bias tables needed)."""

    def find(s: Column) -> Column:
        m, q = F.pow(F.lit(2.0), s["precision"]), 64 - s["precision"]
        r = s["registers"]
        holding = lambda k: F.size(F.filter(r, lambda x: x["r"] == k)).cast("double")
        full = holding(q + 1)
        x = 1 - full / m
        terms = F.sequence(F.lit(1), F.lit(40))
        tau = (1 - x - F.aggregate(terms, F.lit(0.0), lambda a, k: a + F.pow(1 - F.pow(x, F.pow(F.lit(2.0), -k)), F.lit(2.0)) * F.pow(F.lit(2.0), -k))) / 3
        z = F.aggregate(F.sequence(q, F.lit(1), F.lit(-1)), m * F.when((x == 0) | (x == 1), 0.0).otherwise(tau), lambda z, k: 0.5 * (z + holding(k)))
        empty = (m - F.size(r)) / m
        sigma = empty + F.aggregate(terms, F.lit(0.0), lambda a, k: a + F.pow(empty, F.pow(F.lit(2.0), k)) * F.pow(F.lit(2.0), k - 1))
        out = m * m / (2 * math.log(2)) / (z + m * sigma)
        return F.when(F.size(r) == 0, F.lit(0).cast("long")).otherwise(F.round(out).cast("long"))

    return let(col(s), find)


def stderror(s: ColumnLike) -> Column:
    return F.lit(1.04) / F.sqrt(F.pow(F.lit(2.0), col(s)["precision"]))


# ---------------------------------------------------------------- frequent values
def zeta(s: float, terms: int = 10_000) -> float:
    """Sum of k^-s over all k, the tail by Euler and Maclaurin."""
    head = math.fsum(k**-s for k in range(1, terms))
    return head + terms ** (1 - s) / (s - 1) + terms**-s / 2 + s * terms ** (-s - 1) / 12


def _top_share(n: int, skew: float) -> float:
    """Share of the n most common values if the k-th has a share in proportion to k^-skew."""
    return math.fsum(k**-skew for k in range(1, n + 1)) / zeta(skew)


def _mcv_slots(n: int, skew: float) -> int:
    need(n > 0, "n must be positive")
    need(skew > 1, "skew must exceed 1")
    last = n**-skew / zeta(skew)
    return n - 1 + int(1 / (last / (1 - (_top_share(n - 1, skew) if n > 1 else 0.0)))) + 1


def _counted(df: DataFrame, keys: list[str], value: str, slots: int, name: str, **more) -> DataFrame:
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    # limits reach the partitions of the counts before they meet, so a group of very many values is not gathered
    sums = _by(counts, keys).agg(F.sum("n").alias("total"), F.count("*").alias("values"))
    few = counts.withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "value"))).where(F.col("rn") <= slots)
    listed = _by(few, keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "value", F.col("n").alias("count")))).alias("e"))
    joined = listed.join(sums, keys) if keys else listed.crossJoin(sums)
    entries = F.transform("e", lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"), F.lit(0).cast("long").alias("overcount")))
    extra = [F.lit(v).alias(k) for k, v in more.items()]
    sketch = F.struct(F.col("total").alias("n"), F.lit(slots).alias("slots"), *extra, entries.alias("entries"))
    return joined.where("total > 0").select(*keys, sketch.alias(name))


@own_keys
def freq_agg(df: DataFrame, keys: list[str], value: str, min_freq: float, name: str = "sketch") -> DataFrame:
    """Values of a share of min_freq or more, with exact counts, in 1 / min_freq + 1 slots."""
    need(0 < min_freq < 1, "min_freq must lie in (0, 1)")
    return _counted(df, keys, value, int(1 / min_freq) + 1, name, min_freq=float(min_freq), top=0, skew=0.0)


@own_keys
def mcv_agg(df: DataFrame, keys: list[str], value: str, n: int, skew: float = 1.1, name: str = "sketch") -> DataFrame:
    """The n most common values, with exact counts, in as many slots as values of the given skew need."""
    return _counted(df, keys, value, _mcv_slots(n, skew), name, min_freq=0.0, top=n, skew=float(skew))


raw_freq_agg, raw_mcv_agg = freq_agg, mcv_agg


@own_keys
def rollup_freq(df: DataFrame, keys: list[str], sketch: str, name: str = "sketch") -> DataFrame:
    """Merge sketches of one kind. A value that a full sketch lacks may have had as many as its least entry."""
    s = F.col(sketch)
    rows = df.where(s.isNotNull()).select(*keys, s.alias("s"), F.when(F.size(s["entries"]) >= s["slots"], F.element_at(s["entries"], -1)["count"]).otherwise(F.lit(0)).cast("long").alias("least"))
    sums = _by(rows, keys).agg(F.sum("s.n").alias("n"), F.max("s.slots").alias("slots"), F.max("s.min_freq").alias("min_freq"), F.max("s.top").alias("top"), F.max("s.skew").alias("skew"), F.sum("least").alias("all_least"))
    each = rows.select(*keys, "least", F.explode("s.entries").alias("e")).groupBy(*keys, F.col("e.value").alias("value"))
    each = each.agg(F.sum(F.col("e.count") - F.col("least")).alias("c"), F.sum(F.col("e.overcount") - F.col("least")).alias("o"))
    joined = each.join(sums, keys) if keys else each.crossJoin(F.broadcast(sums))
    merged = joined.select(*keys, "value", (F.col("c") + F.col("all_least")).alias("count"), (F.col("o") + F.col("all_least")).alias("overcount"), "n", "slots", "min_freq", "top", "skew")
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    few = merged.withColumn("rn", F.row_number().over(w.orderBy(F.desc("count"), "value"))).where("rn <= slots")
    listed = _by(few, keys).agg(*(F.max(c).alias(c) for c in ("n", "slots", "min_freq", "top", "skew")), F.sort_array(F.collect_list(F.struct("rn", "value", "count", "overcount"))).alias("e"))
    entries = F.transform("e", lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"), x["overcount"].alias("overcount")))
    return listed.where("n is not null").select(*keys, F.struct("n", "slots", "min_freq", "top", "skew", entries.alias("entries")).alias(name))


def freq_values(s: ColumnLike) -> Column:
    """array<struct<value, min_freq, max_freq>>."""
    s = col(s)
    return F.transform(s["entries"], lambda e: F.struct(e["value"].alias("value"), ((e["count"] - e["overcount"]) / s["n"]).alias("min_freq"), (e["count"] / s["n"]).alias("max_freq")))


def freq_into_values(s: ColumnLike) -> Column:
    """Rows (value, min_freq, max_freq)."""
    return F.inline(freq_values(s))


def topn_array(s: ColumnLike, n: int | None = None, skew: float = 1.1) -> Column:
    """The most common values: of a freq_agg those of its share, of an mcv_agg as many as it was made for. For an
    mcv_agg, more than that, or counts that do not bear the skew out, are an error."""

    def find(s: Column) -> Column:
        of_freq = s["min_freq"] > 0
        entries = F.when(of_freq, F.filter(s["entries"], lambda e: e["count"] / s["n"] >= s["min_freq"])).otherwise(s["entries"])
        want = F.lit(n) if n is not None else F.when(of_freq, F.size(s["entries"])).otherwise(s["top"])
        taken = F.slice(F.transform(entries, lambda e: e["value"]), 1, want)
        held = F.aggregate(F.slice(entries, 1, want), F.lit(0.0), lambda a, e: a + e["count"])
        wrong = F.when(~of_freq & (want > s["top"]), F.lit("the sketch was made for fewer values"))
        if n is not None:
            wrong = wrong.when(~of_freq & (F.size(s["entries"]) >= s["slots"]) & (held / s["n"] < _top_share(n, skew)), F.lit("the data are not skewed enough"))
        return F.when(wrong.isNotNull(), F.slice(F.transform(F.array(F.raise_error(F.coalesce(wrong, F.lit("")))), lambda e: F.get(taken, F.lit(0))), 1, 0)).otherwise(taken)

    return let(col(s), find)


def topn(s: ColumnLike, n: int | None = None, skew: float = 1.1) -> Column:
    """Rows of values."""
    return F.explode(topn_array(s, n, skew))


def max_frequency(s: ColumnLike, value) -> Column:
    s = col(s)
    hit = F.get(F.filter(s["entries"], lambda e: e["value"] == (value if isinstance(value, Column) else F.lit(value))), F.lit(0))
    return F.coalesce(hit["count"] / s["n"], F.lit(0.0))


def min_frequency(s: ColumnLike, value) -> Column:
    s = col(s)
    hit = F.get(F.filter(s["entries"], lambda e: e["value"] == (value if isinstance(value, Column) else F.lit(value))), F.lit(0))
    return F.coalesce((hit["count"] - hit["overcount"]) / s["n"], F.lit(0.0))


# ---------------------------------------------------------------- count-min
@own_keys
def count_min_sketch(df: DataFrame, keys: list[str], value: str, error: float, probability: float, name: str = "sketch") -> DataFrame:
    """Item counts within error * n with the given probability of more: width e / error, depth ln(1 / probability)."""
    need(0 < error < 1 and 0 < probability < 1, "error and probability must lie in (0, 1)")
    width, depth = math.ceil(math.e / error), max(1, math.ceil(math.log(1 / probability)))
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("string").alias("v"))
    rows = rows.groupBy(*keys, "v").agg(F.count("*").alias("n"))  # each item is hashed once
    cells = rows.select(*keys, "n", F.explode(F.array(*(_cell(F.col("v"), i, width) for i in range(depth)))).alias("cell"))
    counts = cells.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))
    sketch = F.struct(F.lit(width).alias("width"), F.lit(depth).alias("depth"), F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("cells"))
    return _by(counts, keys).agg(sketch.alias(name))


def _cell(v: Column, row: int | Column, width: int | Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(row), v), width if isinstance(width, Column) else F.lit(width)) + F.lit(row) * width


def approx_count(item, s: ColumnLike) -> Column:
    """Estimated number of times that item was counted, over all rows of the sketch."""
    s = col(s)
    v = (item if isinstance(item, Column) else F.lit(item)).cast("string")
    held = lambda i: F.coalesce(F.try_element_at(s["cells"], _cell(v, i, s["width"]).cast("long")), F.lit(0).cast("long"))
    return F.array_min(F.transform(F.sequence(F.lit(0), s["depth"] - 1), held))

