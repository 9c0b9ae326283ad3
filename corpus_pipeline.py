"""The corpus pipeline: each stage takes the documents that the one before left.

Stages take (spark, docs, sf_dir) and return a frame with the columns of documents, the
last one the packed sequences. Between stages the frame is stored in the shared folder
and read again, so each stage starts from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbflow.llm import exactdedup, mixing, ngramjoin, packing, qualityfm
from kerbflow.llm.common import read_documents, stage
from kerbflow.llm.queries import read_labels


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go."""
    machine = qualityfm.fit(docs, read_labels(spark, sf_dir))
    return qualityfm.accepted(docs, machine)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return exactdedup.kept_documents(docs, exactdedup.fresh_index(spark))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngramjoin.representatives(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken by weight: a row for each document and pass, with the words taken."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence and the place each goes to."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Learned scores, minhash paths and pseudorandom orders can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for k, (name, stage_of) in enumerate(STAGES):
        docs = stage_of(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name.replace('_', '-')}")
    return docs
