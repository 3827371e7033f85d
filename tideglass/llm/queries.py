"""The operators bound to the synthetic tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, lm, media, mixing, ngram_join, oracle, quality, substring, toxicity, warc, wordpiece


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(common.documents(spark, sf_dir))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_documents(common.documents(spark, sf_dir))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(common.documents(spark, sf_dir))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(common.documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "removed_bytes", "spans", "first_ids", F.sha2("text", 256).alias("text_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mix": op2_mix,
    "op3_ngram_join": op3_ngram_join,
    "op4_media": op4_media,
    "op5_lm": op5_lm,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL = {
    "op2_mix": mixing.oracle_sql(),
    "op3_ngram_join": oracle.ngram_join(),
    "op6_warc": oracle.warc(),
    "op7_quality": oracle.quality_rules(),
}
