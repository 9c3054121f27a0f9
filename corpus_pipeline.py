"""A corpus pipeline of training-data operators: quality, toxicity, near copies, benchmark decontamination, encoding.

Each stage reads what its predecessor wrote and works on all of it. The classifiers are fitted on labelled rows that the
stage itself gets (a bounded sample, see the operators); labels are never inputs of a score.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import bpe, decontaminate, jaccard, quality, toxicity
from sieveline.llm.common import drop_paths, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 go."""
    return quality.keep_good(docs, quality.train(docs, _table(spark, sf_dir, "labels")), threshold=0.3)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are toxic at a probability of 0.5 go."""
    return toxicity.keep_civil(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")), threshold=0.5)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.keep_one(docs, width=5, percent=75)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or the whole of a shorter one, go."""
    return decontaminate.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"), width=10)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers and digests of each document that stayed."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_copies", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: Trained models are no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written and read again; a result that the next stage has read is deleted."""
    docs, made = _table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        before, made = made, []
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", made)
        drop_paths(spark, before)
    return docs
