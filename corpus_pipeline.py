"""Corpus pipeline: documents to encoded documents, stage by stage.

Each stage reads what its predecessor wrote, works on all of it and returns the columns of
``documents``; the last returns the encoding of what is left. Rows whose columns are null, texts
that are empty, repeated rows and an empty table pass through as each operator defines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.llm import bag_minhash, bpe_trie, divergence, line_dedup, mixing
from leadlens.llm.common import fresh, prepare
from leadlens.llm.queries import vocabulary
from leadlens.session import work_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the quality rules reject go."""
    prepare(spark)
    kept = divergence.judge(docs, divergence.references(docs)).where("kept").select("doc_id").distinct()
    return _only(docs, kept)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: later copies of lines go; a document that loses all its lines goes with them."""
    prepare(spark)
    out = line_dedup.dedup(docs)
    empty = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~empty).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each class of near-duplicates, the document with the least id stays."""
    prepare(spark)
    first = bag_minhash.classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id")
    return _only(docs, first)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: each document as often as the mix takes it."""
    prepare(spark)
    times = mixing.mix(docs).where("times > 0").groupBy("doc_id").agg(F.max("times").alias("times"))
    times = times.select(F.col("doc_id").alias("id"), F.sequence(F.lit(1), F.col("times")).alias("passes"))
    turn = fresh(docs, "turn")
    out = docs.alias("d").join(times.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.id")))
    return out.select("d.*", F.explode("t.passes").alias(turn)).drop(turn)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: ids of every document, and digests of them and of the decoded text."""
    prepare(spark)
    return bpe_trie.encode(docs, vocabulary("byte_bpe_50k.json"), ids=False, digests=True)


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.alias("d").join(ids.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]

#: SQL cannot encode; tests/llm holds the pipeline against a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = work_dir(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
