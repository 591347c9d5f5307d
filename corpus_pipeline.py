"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and judges all documents that its
predecessor kept. All but the last return the columns of documents; the last
returns doc_id, ids, n_tokens and lossless. Empty tables pass through every stage;
nulls, ties and repeated rows are treated as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carelake.llm import minhash, mixing, quality, sentencepiece_codec, substring
from carelake.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or meet a learned rule go."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 on five-word shingles the smallest doc_id stays."""
    return minhash.dedup(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has go."""
    return substring.strip(docs, window=50)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut to their budgets of 90 in 100 tokens, none is repeated."""
    return mixing.take(docs, fraction=0.9, max_epochs=1)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become piece ids under seeded merge-dropout."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("piece_encoding", piece_encoding),
]

#: Learned rules, seeded orders and merges have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
