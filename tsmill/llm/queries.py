"""Queries of the corpus operators, with production parameters, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tsmill.llm.imatch import SQL as imatch_sql
from tsmill.llm.mixing import SQL as mixing_sql


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsmill.llm.langid import identify

    return identify(_docs(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsmill.llm.simhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsmill.llm.mixing import mix

    return mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsmill.llm.bpe import digests

    return digests(_docs(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsmill.llm.sharding import contents, shard

    return contents(*shard(_docs(spark, sf_dir)))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsmill.llm.imatch import fingerprints

    return fingerprints(_docs(spark, sf_dir))


def op7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsmill.llm.spans import remove_repeated

    return remove_repeated(_docs(spark, sf_dir).select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsmill.llm.toxicity import rate

    return rate(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsmill.llm.ann import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tsmill.llm.lm import score_documents

    return score_documents(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_language, op2_simhash, op3_mixing, op4_bpe, op5_sharding, op6_imatch, op7_spans, op8_toxicity, op9_neighbours, op10_lm)}
ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing_sql, "op6_imatch": imatch_sql}
