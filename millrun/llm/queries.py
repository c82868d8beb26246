"""Registered queries of the training-text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from millrun.llm import (bpe, centroids, html, minhash, negatives, packing, quality, rules,
                         sharding, simhash, suffix, tokens, urls)
from millrun.llm.arrow import share_package
from millrun.llm.oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85,
                                   bands=48, rows=8)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"),
                            quality.graded(_table(spark, sf_dir, "labels")))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                  public_tokenizers.PATTERN)


# Verdict, host and path of the rules of op4.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"),
             ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
             ("block", "net", "/fr/")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(_table(spark, sf_dir, "documents"))
    return judged.drop("class_distance", "word_distance")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(_table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    counts = tokens.tokens_by_section(_table(spark, sf_dir, "documents"),
                                      public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                      public_tokenizers.PATTERN)
    return counts.withColumn("n_tokens", counts["n_tokens"].cast("bigint"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_digests(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_likeness(_table(spark, sf_dir, "documents"))


def op11_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=8)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the ids that 7 divides are shifted; anchors are the ids that 100 divides."""
    label = F.col("label").cast("bigint")
    return negatives.hard_negatives(
        _table(spark, sf_dir, "embeddings"),
        label=F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_url_filters": op4_url_filters,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_text": op6_html_text,
    "op7_token_counts": op7_token_counts,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_jump_shards": op11_jump_shards,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_centroids": op13_centroids,
}
