"""The corpus pipeline: stages over documents, each one an operator whose decisions take effect.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
docs of the next.  Null texts, repeated rows and clashing column names are treated as each operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm import bpe, common, mixing, ngram_join, substring, toxicity

#: Columns of documents, which every stage but the last keeps.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose predicted label is 1; each row is judged by its own text, whatever its id.

    Null ids and repeated rows are judged like others; null and empty texts stay unless most such examples are toxic.
    Without labels, or with an empty table, nothing is dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_documents(docs, labels, keep=tuple(COLUMNS[1:])).where("predicted = 0").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies one row, that of the smallest id (null ids last, then by text); of repeated rows one.

    Texts without words (null, empty) are copies of nothing and all stay; an empty table stays empty.
    """
    return ngram_join.one_of_each(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occurred in an earlier document out of the texts; no row goes.

    Null and empty texts stay as they are; n_chars follows the text.  Rows of equal id and text are one document and get
    the same text; null ids come last in the order of occurrence.  An empty table stays empty.
    """
    out = substring.dedup_substrings(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source has its share of words.

    A null source is a source, the last; null ids and repeated rows come as often as their share of the mix says; texts
    without words have size 0 and come as often as their source's whole epochs, or once more.  An empty table stays empty.
    """
    return mixing.expand(docs, mixing.mix(docs)).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded texts, a row for each row; a null text is the empty one."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("bpe", tokenize),
]

#: The chunking and the merges have no SQL; the tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
