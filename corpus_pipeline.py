"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; all but the
last return the columns of ``documents``. What a stage returns is written as Parquet and
read again as the next one's ``docs``.

Defined cases are those of the operators: rows without text are empty documents and fail
the quality rules; rows without id, or that share one, are rows of their own for near-dedup;
empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrun.llm import minhash, packing, quality, rules, suffix
from millrun.llm.arrow import share_package, small_batches
from millrun.session import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade (good, not toxic) is a half or more."""
    share_package(spark)
    small_batches(spark)
    ratings = quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_top(docs, ratings)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base counts and are near their language's reference."""
    share_package(spark)
    small_batches(spark)
    return rules.keep_good(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 on five-word shingles."""
    share_package(spark)
    small_batches(spark)
    return minhash.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    share_package(spark)
    small_batches(spark)
    return suffix.cut_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    share_package(spark)
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("packing", pack),
]

ORACLE_SQL = None  # models and packing have no SQL; tests check each stage by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every result but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
