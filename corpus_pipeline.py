"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage works on all that the one before it kept, in the columns of
``documents``; the last adds the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm import mixing, pieces, pii, toxicity, verified
from lithic.llm.common import cut, read


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores 0.5 or more go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return docs.where(toxicity.score_of(spark, F.col("text"), model) < 0.5)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8 alike) one document stays."""
    return verified.drop_near_copies(docs)


def pseudonyms_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of their format."""
    return pii.pseudonymise(docs, pii.key_of(spark), counted=False)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the check of what they decode to."""
    return pieces.encode_decode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_copies", near_copies_stage),
    ("pseudonyms", pseudonyms_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Restored text, fingerprints and merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
