"""Mixing sources to target weights with a low-discrepancy schedule.

Slots 0, 1, 2, ... carry the golden-ratio points frac((slot + 1) / phi). A point falls into one source's interval of the
cumulative targets, so any stretch of the schedule holds every source in its proportion; slots are ranked within their
source. Each source's documents are shuffled by hash and laid end to end, again and again; of that line a source takes
its target, rounded to words, cut into as many blocks of equally many words (to one) as it has slots, and its r-th slot
takes block r. So a source is repeated only after it has been used up, and has its target where the schedule ends,
whatever its size. A source too small to get a slot gets one at the end. Everything is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsmill.llm.common import WORD, cut

#: 1 / phi.
STEP = 0.6180339887498949
WEIGHTS = (3.0, 1.0, 2.0)
#: Slots of the schedule; fewer, if the mix takes fewer words.
SLOTS = 65536
#: Bits of the shuffling hash.
HASH_BITS = 60
#: Sources, if so many or fewer, and their slots are broadcast.
FEW = 10_000


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def shuffling_hash(doc_id: str = "doc_id", text: str = "text"):
    """A number of HASH_BITS bits from the MD5 of id and text."""
    both = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size in words (null text: 0), the shuffling hash of each row, and the columns keep."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        shuffling_hash().alias("h"),
        *keep,
    )


def targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sid, source, source_size, weight, target of each source, in code point order, null last.

    Target is the smaller of cap * source_size and level * weight, with the one level at which they sum to
    share * all words: sources are passed in the order in which a rising level meets their caps.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("sid", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    met = ranked.withColumn("level", left / free).withColumn("open", F.col("level") <= F.col("most") / F.col("weight"))
    level = F.coalesce(F.min_by(F.when(F.col("open"), F.col("level")), F.struct(~F.col("open"), F.col("most") / F.col("weight"), F.col("sid"))).over(everything), F.lit(float("inf")))
    return met.withColumn("target", F.least("most", F.col("weight") * level)).select("sid", "source", "source_size", "weight", "target")


def schedule(by_source: DataFrame, slots: int) -> DataFrame:
    """sid, r, slot: the slots of each source with a quota, ranked from 0.

    Points and the starts of the sources' intervals are put in one order, in which a point belongs to the last start
    before it. There are `slots` points and a row for each source.
    """
    spark = by_source.sparkSession
    i = F.col("id") + 1
    points = spark.range(slots).select(F.col("id").alias("slot"), (i * F.lit(STEP) - F.floor(i * F.lit(STEP))).alias("u"), F.lit(None).cast("int").alias("sid"))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    wanted = by_source.where("quota > 0")
    total = F.sum("quota").over(Window.partitionBy()).cast("double")
    starts = wanted.select(F.lit(-1).cast("long").alias("slot"), (F.coalesce(F.sum("quota").over(before), F.lit(0)) / total).alias("u"), F.col("sid").cast("int").alias("sid"))
    line = Window.orderBy("u", "slot", "sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = points.unionByName(starts).withColumn("sid", F.last("sid", ignorenulls=True).over(line)).where("slot >= 0").select("sid", "slot")
    without = wanted.select(F.col("sid").cast("int").alias("sid")).join(placed.select("sid").distinct(), "sid", "left_anti")
    every = placed.unionByName(without.select("sid", (F.col("sid") + F.lit(slots)).cast("long").alias("slot")))
    return every.withColumn("r", F.row_number().over(Window.partitionBy("sid").orderBy("slot")) - 1).select("sid", F.col("r").cast("long").alias("r"), "slot")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, h, size, source_size, target, taken and slot of each row of docs, and its columns keep: words the mix
    takes of it, repeats counted, and the first slot that takes some (null: none does).

    Null or blank texts have size 0 and are never taken; a null source is a source, ordered last; rows that repeat
    count each; ties in the hash go by doc_id, size and keep. No rows: no rows. The outcome depends on the rows alone, not on their
    order or partitioning. Columns other than doc_id, text, source and keep are not read.
    """
    if not 0 < cap <= 2:
        raise ValueError("cap must lie in (0, 2]")
    sized = cut(sizes(docs, keep), "sizes")
    quota = F.least(F.round("target").cast("long"), 2 * F.col("source_size"))
    by_source = cut(targets(sized, weights, share, cap).withColumn("quota", quota), "sources")
    rows = sized.count()
    n_sources, words = by_source.agg(F.count("*"), F.coalesce(F.sum("quota"), F.lit(0))).first()
    few = n_sources <= FEW
    slots = cut(schedule(by_source, max(1, min(SLOTS, words))), "slots")
    with_slots = by_source.join(slots.groupBy("sid").agg(F.count("*").alias("n_slots")), "sid", "left")

    buckets = rows // 1024 + 1
    bucket = F.floor(F.col("h") / F.lit(float(1 << HASH_BITS)) * buckets)
    s = with_slots.withColumnRenamed("source", "__source")
    keyed = sized.join(_small(s, few), F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("bucket", bucket)
    full = keyed.where("size > 0")
    sums = full.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    run = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    placed = full.withColumn("start", F.coalesce(F.sum("size").over(run), F.lit(0))).join(sums, ["sid", "bucket"])
    placed = placed.withColumn("start", F.col("start") + F.col("base"))
    # where a document stands on the line: once, or twice if the source is used up before its quota is met
    passes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("quota") - 1 - F.col("start")) / F.col("source_size"))).cast("int"))
    at = placed.withColumn("pass", F.explode(passes)).withColumn("x", F.col("start") + F.col("pass") * F.col("source_size"))
    at = at.withColumn("y", F.least(F.col("x") + F.col("size"), F.col("quota")))
    block_of = lambda x: F.floor(((x + 1) * F.col("n_slots") - 1) / F.col("quota"))
    blocks = F.when(F.col("y") > F.col("x"), F.sequence(block_of(F.col("x")), block_of(F.col("y") - 1)))
    pieces = at.withColumn("r", F.explode_outer(blocks))
    begin, end = (F.floor(r * F.col("quota") / F.col("n_slots")) for r in (F.col("r"), F.col("r") + 1))
    held = F.greatest(F.lit(0), F.least("y", end) - F.greatest("x", begin))
    columns = ["doc_id", "source", "h", "size", "source_size", "target", *keep]
    got = pieces.join(_small(slots, few), ["sid", "r"], "left")
    got = got.groupBy("sid", "bucket", "start", *columns).agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), held)), F.lit(0)).cast("long").alias("taken"), F.min("slot").alias("slot"))
    rest = keyed.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("slot"))
    return got.select(*columns, "taken", "slot").unionByName(rest)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs, each as often as the mix takes it: words taken over size, rounded half up (0, 1 or 2 times).

    Rows are told apart by a 128-bit hash of all their columns; rows that agree in all of them share what the mix takes of
    them. Null or blank texts are never taken. No rows: no rows. Columns of any name pass through.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in own.items()))
    k1, k2 = F.xxhash64(*own.values()), F.xxhash64(F.lit(1), *own.values())
    named = docs.select("doc_id", "text", "source", F.xxhash64(*docs.columns).alias("k1"), F.xxhash64(F.lit(1), *docs.columns).alias("k2"))
    plan = mix(named, keep=("k1", "k2"), **options).where("taken > 0")
    plan = plan.groupBy("k1", "k2").agg(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("copies")).where("copies > 0")
    # equal rows fold into one before texts are shuffled, and the plan is joined where they then are
    rows = plain.groupBy(k1.alias("k1"), k2.alias("k2")).agg(*(F.first(k).alias(k) for k in own.values()))
    joined = rows.join(plan, ["k1", "k2"]).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return joined.select(*(F.col(k).alias(c) for c, k in own.items()))


#: SQL of op3_mixing for DuckDB. The schedule decides in which order words are taken; how many of each document follows
#: from its place on its source's line alone.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][sid % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS most FROM ranked),
met AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER w, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE)) AS level
  FROM weighed WINDOW w AS (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
open_at AS (SELECT coalesce((SELECT level FROM met WHERE level <= most / weight ORDER BY most / weight, sid LIMIT 1), 'infinity'::DOUBLE) AS level),
targets AS (SELECT met.source, source_size, least(most, weight * open_at.level) AS target FROM met, open_at),
line AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, least(CAST(round(t.target) AS BIGINT), 2 * t.source_size) AS quota,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE greatest(0, least(size, quota - start)) + greatest(0, least(size, quota - source_size - start)) END AS BIGINT) AS taken
FROM line
"""
