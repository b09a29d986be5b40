"""Structured Streaming: incremental ingest, change streams, windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stages import condition


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder where all executors can write."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet table's files, as they come.

    The path may be a folder or one file: as a pattern it can be either.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process all that is available into a Parquet table, exactly once.

    The checkpoint in ``folder`` is the resume token: the next call goes on
    where this one ended.
    """
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(chunks: DataFrame, folder: str) -> DataFrame:
    """Deduplicate a stream of chunks against all that came before.

    What has been seen is keyed state, dealt by fingerprint and kept in the
    folder's checkpoint: a batch costs what it holds, not what came before.
    Returns the distinct ``(fp, chunk_len)`` so far.
    """
    spark = chunks.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        return run_once(chunks.select("fp", "chunk_len").dropDuplicates(["fp"]), folder)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def start_at(stream: DataFrame, column: str, moment) -> DataFrame:
    """A change stream from a moment on, that moment included."""
    return stream.where(F.col(column) >= F.lit(moment))


def watch(stream: DataFrame, filter_: dict) -> DataFrame:
    """A change stream: the changes that a filter lets through."""
    return stream.where(condition(filter_))


def full_document(changes: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Changes with the current document beside them."""
    return changes.join(table, key, "left")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; the watermark bounds the state."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
