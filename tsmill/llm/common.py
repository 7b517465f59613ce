"""Helpers that the corpus operators share: shared storage, hashing of ids, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, as every operator of this package sees them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_local: dict[str, str] = {}
_folders: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir.

    Only a session in local mode may go without it; it then gets a temporary folder of its own.
    """
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    if not conf.get("spark.master", "").split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="tsmill-")
    return _local[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tsmill-{name}-{uuid.uuid4().hex}"
    _folders[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _folders.pop(path, None)


def cut(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and losing executors loses nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete what cut() wrote, once no plan will read it again."""
    if path := getattr(df, "_cut_path", None):
        delete(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for folder in _local.values():  # of a local session, whose JVM may have ended already
        shutil.rmtree(folder, ignore_errors=True)
    for path, spark in list(_folders.items()):
        try:
            delete(spark, path)
        except Exception:  # the JVM may be gone by now; the cluster's own cleaning of the folder takes the rest
            return


def id_text(column: str = "doc_id"):
    """doc_id as text; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(n: int, column: str = "doc_id"):
    return F.crc32(id_text(column).cast("binary")) % F.lit(n)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, component), component being the smallest node reachable.

    Alternating large-star and small-star rounds over tables in the shared folder. Each round groups by a
    node with min() only, so a hub of any degree is pre-aggregated before the shuffle and no group is
    collected; the joins that follow carry one row per edge.
    """
    links = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"
    )

    def summary(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    before = summary(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u move to u's smallest neighbour
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # small star: u and its smaller neighbours move to the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        nxt = cut(small, "links")
        drop_cut(links)
        links, now = nxt, summary(nxt)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
