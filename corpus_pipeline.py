"""A training corpus from documents, in stages that each read the table the one before wrote.

Toxic documents go, one document of each group of near-duplicates stays, documents with benchmark passages go, sources are
mixed to target weights (documents taken twice stand twice), and what is left becomes token blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventledger.llm import decontam, mixing, neardup, tokenfile, toxicity
from eventledger.llm.common import read, staged


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learned from all labels scores under 0.5."""
    return toxicity.non_toxic(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at 0.8 on shingles of five words."""
    return neardup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontam.clean_documents(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the blocks."""
    return tokenfile.documents_of(tokenfile.write(docs, tokenfile.default_tokenizer()))


STAGES = [
    ("toxicity", non_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_blocks", token_blocks),
]

#: A forest of boosted trees and hash minima have no SQL; tests compare run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each staged as Parquet in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
