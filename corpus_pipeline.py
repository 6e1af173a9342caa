"""From raw documents to token ids: five stages, each written to the shared folder and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import bpe, decontamination, near_dedup, quality, substring_dedup
from winnow.session import materialise

VOCABULARY = "byte_bpe_50k.tiktoken"


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality network rejects. It learns from the labelled documents that came in."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8), the document with the smallest id stays."""
    return near_dedup.keep_one(docs, 80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 35 words or more that stand anywhere else out of the texts; ``n_chars`` follows."""
    return substring_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document, with the number of ids and whether decoding gives the text back."""
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return bpe.encoded(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classify),
    ("MinHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: The stages hold a trained network, so SQL cannot say the rows; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return docs
