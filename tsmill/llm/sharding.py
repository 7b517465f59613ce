"""Sharding by size-tiered compaction, with versioned manifests that are committed atomically.

A store is a folder. Arrivals are appended as small immutable Parquet shards, by the tasks that read them, without a
shuffle. Shards belong to tiers by size, each FANOUT times the one below. Compaction takes each tier of at least FANOUT shards,
lines its shards up and cuts the line into runs of about the target size; each run is read by one task and written as
one file, so no row is shuffled. Every change writes a table of the live shards and then names it in a file
v<number>.json, put in place by a rename that fails if the name is taken: readers see the old version or the new one,
and of two writers one has to begin anew. Replaced shards stay until vacuum() ends the versions that hold them.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsmill.llm.common import new_folder

FANOUT, LEAST_BYTES, TARGET_BYTES, SHARD_ROWS = 4, 4 << 20, 96 << 20, 2000
#: Runs that one job merges.
RUNS = 256
#: How often a change is tried again after others have come first.
TRIES = 20
ENTRY = "path string, bytes long, rows long, least long, most long, tier int, since int"


class Conflict(RuntimeError):
    """Another writer has committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT, least_bytes: int = LEAST_BYTES, target_bytes: int = TARGET_BYTES):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fanout, self.least_bytes, self.target_bytes = fanout, least_bytes, target_bytes
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # ------------------------------------------------------------ files
    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs().listStatus(p)) if self._fs().exists(p) else []

    def _write_text(self, name: str, text: str) -> None:
        out = self._fs().create(self._path(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    # ------------------------------------------------------------ versions
    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max([0, *(int(n[1:-5]) for n in self._names("versions") if n.startswith("v") and n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live shards of a version (the last by default): path, bytes, rows, least and most id, tier, since which version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], ENTRY)
        text = self.spark.read.text(f"{self.folder}/versions/v{version:08d}.json", wholetext=True).first()[0]
        return self.spark.read.schema(ENTRY).parquet(f"{self.folder}/{json.loads(text)['entries']}")

    def commit(self, entries: DataFrame, based_on: int) -> int:
        """Make entries the version after based_on, or raise Conflict if there is one already."""
        table = f"entries/{uuid.uuid4().hex}"
        entries.write.parquet(f"{self.folder}/{table}")
        number = based_on + 1
        draft = f"drafts/{uuid.uuid4().hex}"
        self._write_text(draft, json.dumps({"version": number, "entries": table}))
        self._fs().mkdirs(self._path("versions"))
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        target = self._path(f"versions/v{number:08d}.json")
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(self._path(draft), target, none)
        except Exception as e:
            if self._fs().exists(target):
                raise Conflict(f"version {number} is taken") from e
            raise
        return number

    # ------------------------------------------------------------ shards
    def tier_of(self, size):
        """0 below least_bytes, then one more for each factor of fanout; the target size is the last tier."""
        grown = F.floor(F.log(float(self.fanout), F.greatest(size / F.lit(float(self.least_bytes)), F.lit(1e-9)))) + 1
        return F.when(size < self.least_bytes, 0).when(size >= self.target_bytes // 2, 99).otherwise(grown).cast("int")

    def _entries(self, folder: str, ident: str, since: int) -> DataFrame:
        """Entries of the shards that a job has written to folder."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.folder}/{folder}")
        files = files.select("path", F.col("length").alias("bytes"), F.element_at(F.split("path", "/"), -1).alias("name"))
        rows = self.spark.read.parquet(f"{self.folder}/{folder}").select(F.col(ident).cast("long").alias("id"), F.col("_metadata.file_name").alias("name"))
        held = rows.groupBy("name").agg(F.count("*").alias("rows"), F.min("id").alias("least"), F.max("id").alias("most"))
        # shards without rows are not listed: nothing reads them
        both = files.join(held, "name")
        return both.select(F.concat(F.lit(f"{folder}/"), "name").alias("path"), "bytes", "rows", "least", "most", self.tier_of(F.col("bytes")).alias("tier"), F.lit(since).alias("since"))

    def append(self, docs: DataFrame, ident: str = "doc_id", rows: int = SHARD_ROWS) -> int:
        """Add docs as shards of at most `rows` rows; the new version. Each task writes what it reads."""
        folder = f"data/{uuid.uuid4().hex}"
        docs.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(f"{self.folder}/{folder}")
        return self.add(folder, ident)

    def append_parts(self, docs: DataFrame, part, parts: int, ident: str = "doc_id", rows: int = SHARD_ROWS) -> int:
        """As append(), with a version for each value 0, 1, ... of part; docs are read once."""
        name = "part"
        while name in docs.columns:
            name += "_"
        folder = f"data/{uuid.uuid4().hex}"
        docs.withColumn(name, part).write.partitionBy(name).option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(f"{self.folder}/{folder}")
        for k in range(parts):
            if self._names(f"{folder}/{name}={k}"):
                self.add(f"{folder}/{name}={k}", ident)
        return self.version()

    def add(self, folder: str, ident: str = "doc_id") -> int:
        """Commit the shards of a folder; where other writers come first, again on top of what they have committed."""
        entries = self._entries(folder, ident, 0)
        for _ in range(TRIES):
            base = self.version()
            try:
                return self.commit(self.manifest(base).unionByName(entries.withColumn("since", F.lit(base + 1))), base)
            except Conflict:
                continue
        raise Conflict(f"others came first {TRIES} times")

    def plan(self, entries: DataFrame) -> DataFrame:
        """path, run: which shards are merged with which. Shards of full size and tiers of few shards stay."""
        few = Window.partitionBy("tier")
        line = Window.partitionBy("tier").orderBy("least", "path").rowsBetween(Window.unboundedPreceding, -1)
        crowded = entries.where("tier < 99").withColumn("n", F.count("*").over(few)).where(F.col("n") >= self.fanout)
        cut = F.floor(F.coalesce(F.sum("bytes").over(line), F.lit(0)) / self.target_bytes)
        runs = crowded.select("path", F.struct("tier", cut.alias("cut")).alias("run"))
        return runs.withColumn("size", F.count("*").over(Window.partitionBy("run"))).where("size > 1").drop("size")

    def compact(self, ident: str = "doc_id") -> int | None:
        """Merge one round of runs; the new version, or None if no tier is crowded."""
        base = self.version()
        entries = self.manifest(base)
        runs = self.plan(entries).groupBy("run").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("run").collect()
        if not runs:
            return None
        folder = f"data/{uuid.uuid4().hex}"
        schema = self.spark.read.parquet(f"{self.folder}/{runs[0]['paths'][0]}").schema
        for s in range(0, len(runs), RUNS):  # names and sizes of files reach the driver, rows never
            part = [self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in r["paths"])).coalesce(1) for r in runs[s : s + RUNS]]
            merged = part[0]
            for other in part[1:]:
                merged = merged.union(other)
            merged.write.mode("append").option("compression", "zstd").parquet(f"{self.folder}/{folder}")
        gone = self.plan(entries).select("path")
        live = entries.join(gone, "path", "left_anti").unionByName(self._entries(folder, ident, base + 1))
        return self.commit(live, base)

    def compact_fully(self, ident: str = "doc_id", keep: int = 1) -> int:
        """Compact until no tier is crowded, keeping the last `keep` versions readable; begin a round anew if others come first."""
        tries = 0
        while True:
            try:
                done = self.compact(ident)
            except Conflict:
                tries += 1
                if tries >= TRIES:
                    raise
                continue
            if done is None:
                return self.version()
            self.vacuum(keep)

    def vacuum(self, keep: int = 1) -> int:
        """End all versions but the last `keep` and delete the shards that only they hold; the number of files.

        What no version names is left alone: another writer may be about to commit it.
        """
        numbers = sorted(int(n[1:-5]) for n in self._names("versions") if n.startswith("v") and n.endswith(".json"))
        retired, kept = numbers[:-keep], numbers[-keep:]
        if not retired:
            return 0
        paths = lambda vs: reduce(DataFrame.unionByName, [self.manifest(v).select("path") for v in vs])
        n = 0
        for r in paths(retired).distinct().join(paths(kept), "path", "left_anti").toLocalIterator():
            n += bool(self._fs().delete(self._path(r["path"]), False))
        for v in retired:  # last, so that a vacuum cut short can be repeated
            self._fs().delete(self._path(f"versions/v{v:08d}.json"), False)
        return n

    def read(self, version: int | None = None) -> DataFrame | None:
        """Rows of a version; None if it holds no shard."""
        paths = [r["path"] for r in self.manifest(version).select("path").orderBy("path").toLocalIterator()]
        return self.spark.read.parquet(*(f"{self.folder}/{p}" for p in paths)) if paths else None


def shard(docs: DataFrame, arrivals: int = 4, ident: str = "doc_id", rows: int = SHARD_ROWS, **options) -> tuple[ShardStore, int]:
    """A new store in the shared folder with docs appended in several arrivals and compacted; and its version.

    An arrival is a part of the ids by hash. Null ids, null, empty and very long texts and repeated rows are kept like any other row; a
    table without rows gives a store without shards; columns of any name are kept. The store is new, so no reader has an
    older version in hand: compaction keeps the last one only.
    """
    store = ShardStore(docs.sparkSession, new_folder(docs.sparkSession, "store"), **options)
    store.append_parts(docs, F.pmod(F.xxhash64(ident), F.lit(arrivals)), arrivals, ident, rows)
    return store, store.compact_fully(ident)


def contents(store: ShardStore, version: int, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row that the version's live shards hold: its id, shard number, the shard's tier, rows and bytes, and
    the SHA-256 of its text as read back (null text: null)."""
    live = store.read(version)
    if live is None:
        return store.spark.createDataFrame([], "doc_id long, shard int, tier int, shard_rows long, shard_bytes long, text_sha256 string, version int")
    entries = store.manifest(version)
    number = F.row_number().over(Window.orderBy("least", "most", "rows", "bytes", "path"))
    named = entries.select(F.element_at(F.split("path", "/"), -1).alias("name"), number.cast("int").alias("shard"), "tier", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    rows = live.select(F.col(ident).cast("long").alias("doc_id"), F.sha2(F.col(text).cast("binary"), 256).alias("text_sha256"), F.col("_metadata.file_name").alias("name"))
    return rows.join(named, "name").select("doc_id", "shard", "tier", "shard_rows", "shard_bytes", "text_sha256", F.lit(version).alias("version"))
