"""Exact deduplication: flags, counts, reports, deletion, collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flag_first(chunks: DataFrame) -> DataFrame:
    """``is_unique``: the first occurrence of a fingerprint in ingest order.

    First is least (version, file, chunk); found by a partial aggregation and
    a join, so that a fingerprint with very many chunks is not sorted in one
    task.
    """
    order = F.struct("version", "file_id", "chunk_id")
    firsts = chunks.groupBy("fp").agg(F.min(order).alias("first"))
    return chunks.join(firsts, "fp").withColumn("is_unique", order == F.col("first")).drop("first")


def ref_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("fp").agg(F.count("*").alias("ref_count"), F.max("chunk_len").alias("chunk_len"))


def probe(chunks: DataFrame, store: DataFrame, known: bool = True) -> DataFrame:
    """Chunks whose fingerprint the store holds, or lacks."""
    return chunks.join(store.select("fp"), "fp", "left_semi" if known else "left_anti")


def file_totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_id", "version").agg(F.sum("chunk_len").alias("file_size"), F.count("*").alias("total_chunks"))


def report(chunks: DataFrame, *by: str) -> DataFrame:
    """Totals and the dedup ratio, by nothing or by columns."""
    total, saved = F.sum("chunk_len"), F.sum(F.when(F.col("is_unique"), F.col("chunk_len")).otherwise(0))
    return flag_first(chunks).groupBy(*by).agg(F.count("*").alias("total_chunks"), F.sum(F.col("is_unique").cast("long")).alias("unique_chunks"), total.alias("total_bytes"), saved.alias("unique_bytes"), F.round(total / saved, 6).alias("dedup_ratio"))


def delete_files(recipes: DataFrame, gone: DataFrame) -> DataFrame:
    """Recipe entries without the files (and versions) of ``gone``."""
    return recipes.join(gone, gone.columns, "left_anti")


def collect_garbage(store: DataFrame, recipes: DataFrame) -> DataFrame:
    """Store entries that a recipe still names."""
    return store.join(recipes.select("fp"), "fp", "left_semi")
