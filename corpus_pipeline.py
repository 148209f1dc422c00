"""A corpus from documents to token ids, in five stages.

Quality rules drop documents; near copies shrink to one document of each group; strings that repeat across
documents are cut out; contaminated documents go; what is left is encoded. Each stage is written as Parquet in the
session's shared folder and read again, so a lost executor costs at most a stage's tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terraloom.llm import bpe, decontamination, prob_minhash, quality_rules, suffix_dedup
from terraloom.session import cut_lineage

#: Rank file of the last stage.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose source is not rejected; null texts go."""
    return quality_rules.kept_documents(docs, host="source")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    return prob_minhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings that appear earlier; one that is all repeats stays with an empty text."""
    return suffix_dedup.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's passages do not contaminate."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digests and that of the bytes decoded from them."""
    return bpe.round_trip_digests(docs, RANKS, with_ids=True)


STAGES = [
    ("quality_rules", keep_good_documents),
    ("near_duplicates", keep_one_of_each),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Suffix order, near-duplicate search and byte-pair merges are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
