"""A training corpus from ``documents``: quality rules, exact and near deduplication, mixing, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from tallyloom.llm.queries import DOMAIN, RANKS, TARGETS
from tallyloom.llm.shared import WorkArea


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact_dedup.drop_copies(docs, keep="largest")


def distinct_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row with the smallest id."""
    return near_dedup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says: toxic ones rarely, poor ones half as often."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.expr(DOMAIN).alias("domain"))
    return mixing.mix(docs, labels, TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns and their ids, packed as little-endian unsigned 32-bit integers."""
    return bpe.encode(docs, public_tokenizers.path(RANKS))


STAGES = [("quality", good), ("exact_dedup", distinct_texts), ("near_dedup", distinct_content), ("mixing", mixed), ("bpe", tokens)]

#: Tokenizing and the similarity join can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written and read again as the next one's documents."""
    area = WorkArea(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = area.table(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
