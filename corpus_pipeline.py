"""The training-data pipeline: documents through five operators, one after the other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontam, line_dedup, minhash, mixing, toxicity
from quillgraph.llm.common import Scratch


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on a bounded sample of the labelled rows of the input, takes for ordinary.

    Rows are judged one by one, whatever their ids; null and empty texts stay; without labels nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity_stage(docs, toxicity.fit(toxicity.training_rows(docs, labels)))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many documents hold; all rows stay, null texts stay null."""
    return line_dedup.dedup_stage(docs)


def stage_minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; rows without words or without an id stay."""
    return minhash.near_dedup_stage(docs)


def stage_decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without words stay."""
    return decontam.decontam_stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks, with their place in the mixture; a null source is a source of its own."""
    return mixing.mix_stage(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_line_dedup),
    ("minhash", stage_minhash),
    ("decontam", stage_decontam),
    ("mixing", stage_mixing),
]
#: The first and the last stage can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's rows are written and read again."""
    scratch = Scratch(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
