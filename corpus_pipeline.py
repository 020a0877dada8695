"""From raw documents to piece ids: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontaminate, exact_dedup, minhash, pieces, quality
from lectern.llm.common import temporary, written
from lectern.llm.queries import table, vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's limit."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    return exact_dedup.drop_exact(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id."""
    return minhash.drop_near(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document that stayed, with the next best segmentations."""
    return pieces.encode_pieces(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_leaks),
    ("pieces", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written and read again.

    What a stage writes on its way is deleted when its result is there, and each result when the next is.
    """
    docs = table(spark, sf_dir, "documents")
    with temporary(spark) as keep_last:
        for name, stage in STAGES[:-1]:
            with temporary(spark) as keep:
                docs = keep(written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        keep_last(docs)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Perplexities and n-best segmentations have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None
