"""I-Match fingerprints: hashes of the distinct mid-frequency terms of a text under several randomised lexicons.

Terms are lower-cased runs of letters and digits. The lexicon holds the terms whose document frequency lies in a band, so
their inverse document frequency does. The subsets are EACH random families: a family's subset of level l keeps one lexicon term in 2^l
and lies in that of level l - 1. A subset's component is a hash of the sorted distinct terms of a text that are in it. The first
component takes the whole lexicon or, where a text holds no lexicon term, all its terms, or the text itself. Everything is built
from DataFrame functions.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsmill.llm.common import cut

#: The band of df / number of documents.
BAND = (0.0005, 0.005)
#: Levels 2 to 10, each with EACH subsets.
LEVELS, EACH = tuple(range(2, 11)), 2
#: Cells of the order of documents: one for PER_CELL documents, CELLS at most; and quantiles that the cells divide.
PER_CELL, CELLS, QUANTILES = 128, 100_000, 256
#: Hexadecimal digits of the first component and of the others.
FIRST, OTHER = 16, 8
NONE = "-"


def _threshold(level: int) -> str:
    """A term is in the subset of this level if three hexadecimal digits of its MD5 come before these."""
    return f"{4096 >> level:03x}"


def _levels_held(md5: str, family: int):
    """Of how many levels' subsets a term is a part."""
    digits = F.substring(md5, 1 + 8 * family, 3)
    return sum((digits < _threshold(level)).cast("int") for level in LEVELS)


def _with(family: int, levels: int):
    return lambda x: x[f"held{family}"] >= levels


def _hash60(x):
    """A number of 60 bits from the MD5 of a string."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")


def _terms(text):
    """The distinct terms; the empty string that split() may give is left out."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    return F.array_remove(words, "")


def lexicon(docs: DataFrame, n_docs: int, band=BAND) -> DataFrame:
    """t: hashes of the terms in the band. It holds the mean number of distinct terms of a document over band[0] entries at most."""
    lo, hi = max(2.0, band[0] * n_docs), max(3.0, band[1] * n_docs)
    df = docs.select(F.explode(_terms(F.col("text"))).alias("w")).select(F.xxhash64("w").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    return df.where(F.col("df").between(lo, hi)).select("t")


def placed_in_cells(rows: DataFrame, n: int) -> DataFrame:
    """rows (doc_id, h, ...) with a cell that rises with doc_id, then h; null ids last.

    Quantiles of doc_id bound ranges, which are divided evenly: an outlier among the ids widens the cells of one range only.
    An id that several quantiles fall on, and the null id, are divided by h.
    """
    cells = min(CELLS, n // PER_CELL + 1)
    found = rows.agg(F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000)).first()[0] or [0]
    times = Counter(found)
    top = (1 << 63) - 1
    bounds = sorted(set(found) | {x + 1 for x, c in times.items() if c > 1 and x < top})
    each = -(-cells // QUANTILES)
    sizes = [each * max(1, times[x] - 1) for x in bounds]
    before = [sum(sizes[:i]) for i in range(len(sizes))]
    literals = lambda values: F.array(*map(F.lit, values))
    k = F.greatest(F.lit(1), F.size(F.filter(literals(bounds).cast("array<long>"), lambda b: b <= F.col("doc_id"))))  # quantiles need not reach the least id
    of_k = lambda values: F.element_at(literals(values), F.col("__k"))
    lo, hi = (of_k(list(map(float, v))) for v in (bounds, [*bounds[1:], max(bounds) + 1]))
    of_h = F.col("h") / float(1 << 60)
    share = F.when(of_k([times[x] > 1 for x in bounds]), of_h).otherwise((F.col("doc_id").cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)))
    inside = F.greatest(F.lit(0), F.least(of_k(sizes) - 1, F.floor(share * of_k(sizes))))
    cell = F.when(F.col("doc_id").isNull(), sum(sizes) + F.floor(of_h * cells)).otherwise(of_k(before) + inside)
    return rows.withColumn("__k", k).withColumn("cell", cell.cast("int")).drop("__k")


def _of_side(s: int, known: bool):
    return F.filter("held", lambda x: (x["side"] == s) & (x["known"] == F.lit(known)))


def _likeness(a: list, b: list):
    """Equal components over components that either has."""
    even = sum(((x == y) & (x != NONE)).cast("int") for x, y in zip(a, b))
    held = sum(((x != NONE) | (y != NONE)).cast("int") for x, y in zip(a, b))
    return even / held


def fingerprints(docs: DataFrame, band=BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the next row's text; near_next compares a row with the next row. Rows follow each other by doc_id, rows of one
    doc_id by a hash of the text and by text; null ids come last. The first row follows the last. Null texts count as
    empty; texts are taken whole, and repeated rows are rows like others. No rows: no rows. Columns beside doc_id and
    text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", _hash60(F.col("text")))
    n = rows.count()
    rows = placed_in_cells(rows, n)
    # the first row of each cell also stands at the end of the cell before: 2 * CELLS rows or little more, so they can be broadcast
    firsts = rows.select("cell", F.struct(F.col("doc_id").alias("d"), "h").alias("s")).groupBy("cell").agg(F.min("s").alias("s"))
    firsts = cut(firsts, "firsts")
    around = Window.orderBy("cell")
    last = F.max("cell").over(Window.partitionBy())
    firsts = firsts.select(F.col("cell").alias("c"), F.col("s.d").alias("d"), F.col("s.h").alias("fh"), F.coalesce(F.lag("cell").over(around), last).alias("before"))
    at = (F.col("cell") == F.col("c")) & (F.col("h") == F.col("fh")) & F.col("doc_id").eqNullSafe(F.col("d"))
    placed = rows.join(F.broadcast(firsts), at, "left").withColumn("extra", F.explode(F.when(F.col("c").isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    placed = placed.select("doc_id", "text", "h", "extra", F.when(F.col("extra"), F.col("before")).otherwise(F.col("cell")).alias("cell"))
    order = Window.partitionBy("cell").orderBy("extra", F.col("doc_id").asc_nulls_last(), "h", "text")
    # rows that are equal may all count as first: any of them serves
    lined = placed.select("*", F.length("text").alias("n_chars"), F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next"))
    edited = F.concat(F.expr("left(text, n_chars - cast(floor(n_chars / 2) as int))"), F.coalesce(F.expr("left(next, cast(floor(n_chars / 2) as int))"), F.lit("")))
    lined = lined.withColumn("edited", edited)

    lex = cut(lexicon(rows, n, band), "lexicon")
    known = F.broadcast(lex) if lex.count() <= 2_000_000 else lex
    # the terms of each side follow what stands for a text without lexicon terms, at place 0
    key = ["cell", "rn", "extra", "doc_id", "n_chars", "sha"]
    sides = lined.select("cell", "rn", "extra", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("s"))
    sides = sides.select(*key, F.col("s.side").alias("side"), F.col("s.t").alias("whole"), _terms(F.col("s.t")).alias("terms"))
    every = F.md5(F.when(F.size("terms") > 0, F.array_join(F.sort_array("terms"), " ")).otherwise(F.col("whole")))
    sides = sides.select(*key, "side", F.posexplode(F.concat(F.array(every), F.col("terms"))).alias("place", "w"))
    sides = sides.withColumn("t", F.when(F.col("place") > 0, F.xxhash64("w"))).join(known.withColumn("known", F.lit(True)), "t", "left").where("place = 0 or known")
    sides = sides.withColumn("md5", F.md5("w")).select(*key, "side", "w", F.col("known").isNotNull().alias("known"), *(_levels_held("md5", k).alias(f"held{k}") for k in range(EACH)))
    held = sides.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("w", "side", "known", *(f"held{k}" for k in range(EACH))))).alias("held"))
    held = held.select(*key, *(_of_side(s, True).alias(f"l{s}") for s in (0, 1)), *(_of_side(s, False)[0]["w"].alias(f"every{s}") for s in (0, 1)))
    for family in range(EACH):  # each level is sought in the one below
        for s in (0, 1):
            held = held.withColumn(f"l{s}_{family}_1", F.filter(f"l{s}", _with(family, 1)))
        for n in range(2, len(LEVELS) + 1):
            for s in (0, 1):
                held = held.withColumn(f"l{s}_{family}_{n}", F.filter(f"l{s}_{family}_{n - 1}", _with(family, n)))

    def component(name: str, digits: int, empty):
        return F.when(F.size(name) > 0, F.substring(F.md5(F.array_join(F.col(name)["w"], " ")), 1, digits)).otherwise(empty)

    def components(s: int):
        yield component(f"l{s}", FIRST, F.substring(f"every{s}", 1, FIRST))
        for family in range(EACH):
            for n in range(1, len(LEVELS) + 1):
                yield component(f"l{s}_{family}_{n}", OTHER, F.lit(NONE))

    hashed = held.select(*key, *(F.array(*components(s)).alias(f"c{s}") for s in (0, 1)))
    along = Window.partitionBy("cell").orderBy("rn")
    following = hashed.select("*", F.lead("c0").over(along).alias("c2")).where("not extra")
    parts = lambda c: [F.element_at(c, i + 1) for i in range(EACH * len(LEVELS) + 1)]
    return following.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        F.array_join("c0", ".").alias("fingerprint"),
        F.array_join("c1", ".").alias("edited_fingerprint"),
        _likeness(parts("c0"), parts("c1")).alias("near_edited"),
        _likeness(parts("c0"), parts("c2")).alias("near_next"),
    )


def _sql() -> str:
    """SQL of op6_imatch for DuckDB."""
    inside = [f"substr(md5(w), {1 + 8 * family}, 3) < '{_threshold(level)}'" for family in range(EACH) for level in LEVELS]
    parts = ", ".join(f"coalesce(substr(md5(string_agg(w, ' ' ORDER BY w) FILTER (WHERE {x})), 1, {OTHER}), '{NONE}')" for x in inside)
    alike = lambda a, b: f"len(list_filter(list_zip({a}, {b}), lambda x: x[1] = x[2] AND x[1] <> '{NONE}')) / CAST(len(list_filter(list_zip({a}, {b}), lambda x: x[1] <> '{NONE}' OR x[2] <> '{NONE}')) AS DOUBLE)"
    return rf"""
WITH numbered AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text,
    row_number() OVER (ORDER BY doc_id NULLS LAST, substr(md5(coalesce(text, '')), 1, 15), coalesce(text, '')) AS rn, count(*) OVER () AS n
  FROM documents),
lined AS (SELECT a.doc_id, a.text, a.rn, a.n, b.text AS next, b.rn AS next_rn, length(a.text) AS n_chars FROM numbered a JOIN numbered b ON b.rn = a.rn % a.n + 1),
edits AS (SELECT *, left(text, n_chars - n_chars // 2) || left(next, n_chars // 2) AS edited FROM lined),
df AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) AS w FROM numbered) GROUP BY w),
lexicon AS (
  SELECT w FROM df, (SELECT count(*) AS n FROM documents)
  WHERE df BETWEEN greatest(2.0, {BAND[0]} * n) AND greatest(3.0, {BAND[1]} * n)),
sides AS (
  SELECT rn, side, whole, list_distinct(regexp_extract_all(lower(whole), '[\p{{L}}\p{{N}}]+')) AS terms
  FROM (SELECT rn, 0 AS side, text AS whole FROM edits UNION ALL SELECT rn, 1, edited FROM edits)),
held AS (SELECT rn, side, s.w FROM (SELECT rn, side, unnest(terms) AS w FROM sides) s SEMI JOIN lexicon l ON s.w = l.w),
parts AS (SELECT rn, side, [substr(md5(string_agg(w, ' ' ORDER BY w)), 1, {FIRST}), {parts}] AS c FROM held GROUP BY rn, side),
components AS (
  SELECT s.rn, s.side, coalesce(p.c, list_concat([substr(md5(CASE WHEN len(s.terms) > 0 THEN array_to_string(list_sort(s.terms), ' ') ELSE s.whole END), 1, {FIRST})], {[NONE] * len(inside)!r})) AS c
  FROM sides s LEFT JOIN parts p ON s.rn = p.rn AND s.side = p.side)
SELECT e.doc_id, CAST(e.n_chars AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256,
  array_to_string(a.c, '.') AS fingerprint, array_to_string(b.c, '.') AS edited_fingerprint,
  {alike("a.c", "b.c")} AS near_edited, {alike("a.c", "f.c")} AS near_next
FROM edits e JOIN components a ON a.rn = e.rn AND a.side = 0 JOIN components b ON b.rn = e.rn AND b.side = 1 JOIN components f ON f.rn = e.next_rn AND f.side = 0
"""


SQL = _sql()
