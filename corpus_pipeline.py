"""Corpus pipeline: five stages over documents, each applying one training-data operator to all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and reads it back for the next.
All stages but the last return the columns of docs, in their order, extra ones included. Null texts count as empty ones in every stage
(and stay null), null ids and sources are values like others, repeated rows are decided alike, and an empty table stays empty; what else a
stage does with ties is said by its operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import bpe, lines, mixing, quality, simhash
from quadloom.llm.common import ensure_checkpoint_dir, table

#: A trained classifier, SimHash and a BPE vocabulary cannot be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant predicts good; it learns from the labels table, held-out labels excepted."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of line runs of 50 words and more; n_chars follows the text."""
    left = lines.remove_repeats(docs).drop("__ql_lines", "__ql_removed")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 at least."""
    return simhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it does, by training position."""
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, with digests of the ids and of their decoded bytes."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. What lies between them is written below the shared checkpoint folder, and deleted when the next stage is
    written; the last result stays there for the caller to read."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            before = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)
    return docs
