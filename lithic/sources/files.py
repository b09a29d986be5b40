"""Sources and sinks: files of bytes, indexes, recipes, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(df: DataFrame, id_col: str, text_col: str = "text", version: int = 0) -> DataFrame:
    """``(file_id, version, content)`` from a table of texts; null is empty."""
    return df.select(F.col(id_col).alias("file_id"), F.lit(version).alias("version"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("content"))


def binary_files(spark: SparkSession, path: str, version: int = 0) -> DataFrame:
    """``(file_id, version, content)``; the id is the SHA-256 of the path.

    One row holds one file: split files of many gigabytes before reading.
    """
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.sha2(F.col("path"), 256).alias("file_id"), F.lit(version).alias("version"), "content")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The second version of a text table: by id modulo 3, the first line goes,
    ``the`` is written in capitals, or a line is added."""
    t, kind = F.coalesce(F.col(text_col), F.lit("")), F.pmod(F.col(id_col), F.lit(3))
    new = F.when(kind == 0, F.regexp_replace(t, "^[^\n]*\n?", "")).when(kind == 1, F.replace(t, F.lit("the "), F.lit("THE "))).otherwise(F.concat(t, F.lit("\nAn added line.")))
    return docs.withColumn(text_col, new)


def trace(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width fingerprints, 18 characters a line."""
    return spark.read.text(path).select(F.substring("value", 1, 18).alias("fp")).where(F.length("fp") == 18)


def next_version(recipes: DataFrame) -> DataFrame:
    """``(file_id, next_version, previous_version)``."""
    last = F.max("version")
    return recipes.groupBy("file_id").agg((last + 1).alias("next_version"), last.alias("previous_version"))


def write_files(files: DataFrame, path: str, name: str = "file_id") -> None:
    """Restored files as rows ``(name, content)`` of a table, one partition a version."""
    files.select(F.col(name).cast("string").alias("name"), "version", "content").write.mode("append").partitionBy("version").parquet(path)
