"""The corpus pipeline: language ID, exact dedup, near-duplicate join, mixing to target weights, best-fit packing.

Each stage takes all that the one before kept. What a stage returns is written to the shared folder and read again
as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import documents, materialize
from tessera.llm.exact_dedup import drop_copies
from tessera.llm.language_kernel import keep_identified
from tessera.llm.ngram_join import drop_near_copies
from tessera.llm.packing import pack_documents
from tessera.llm.source_mixing import mixed_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter, or no text) go."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five words, the one with the smallest doc_id stays."""
    return drop_near_copies(docs, words=5, num=4, den=5)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("best_fit_packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs


#: Fitted models, hashes and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
