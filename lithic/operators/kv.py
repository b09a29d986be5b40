"""Ordered key-value queries over a log ``(key, seq, op, value)``, op put or del."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with ``rows(key, seq, value)`` put."""
    return log.unionByName(rows.select("key", "seq", F.lit("put").alias("op"), "value"))


def delete(log: DataFrame, rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast(log.schema["value"].dataType)
    return log.unionByName(rows.select("key", "seq", F.lit("del").alias("op"), none.alias("value")))


def batch(log: DataFrame, operations: DataFrame, after: int) -> DataFrame:
    """An atomic batch ``(at, key, op, value)``: one append, numbers in order of ``at``."""
    return log.unionByName(operations.select("key", (F.col("at") + after + 1).alias("seq"), "op", "value"))


def latest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """``(key, value, seq)`` as of a sequence number; deleted keys are gone.

    One partial aggregation by key, no sort of a key's history.
    """
    seen = log if snapshot is None else log.where(F.col("seq") <= snapshot)
    last = seen.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("m"))
    return last.where("m.op = 'put'").select("key", "m.value", "m.seq")


def get(log: DataFrame, key, snapshot: int | None = None) -> DataFrame:
    return latest(log.where(F.col("key") == key), snapshot)


def scan(log: DataFrame, low=None, high=None, snapshot: int | None = None, reverse: bool = False, order: Column | None = None) -> DataFrame:
    """Keys in [low, high) in order, or against it, or by another comparator."""
    rows = log
    if low is not None:
        rows = rows.where(F.col("key") >= low)
    if high is not None:
        rows = rows.where(F.col("key") < high)
    by = F.col("key") if order is None else order
    return latest(rows, snapshot).orderBy(by.desc() if reverse else by.asc())


def compact(log: DataFrame, snapshots: int | list[int] | None = None) -> DataFrame:
    """What compaction keeps for the snapshots that are open.

    Between two snapshots the newest entry of each key, above the last one
    all; up to the first one no tombstone, as it hides nothing there.
    """
    marks = sorted([snapshots] if isinstance(snapshots, int) else snapshots or [])
    span = reduce(lambda a, s: a + (F.col("seq") > s).cast("int"), marks, F.lit(0))
    rows = log.withColumn("_span", span)
    above = F.lit(False) if not marks else F.col("_span") == len(marks)
    newest = rows.where(~above).groupBy("key", "_span").agg(F.max(F.struct("seq", "op", "value")).alias("m"))
    newest = newest.where("m.op = 'put' or _span > 0").select("key", "m.seq", "m.op", "m.value")
    return newest.unionByName(rows.where(above).select("key", "seq", "op", "value"))


def write_sorted(log: DataFrame, path: str, partitions: int, compression: str = "zstd", block_mb: int = 128, bloom_bits: int | None = 10) -> None:
    """Range-partitioned and sorted by key, so that scans prune files and row groups.

    ``bloom_bits`` for each distinct key make point reads skip row groups.
    """
    out = log.repartitionByRange(partitions, "key").sortWithinPartitions("key", F.desc("seq")).write
    out = out.option("compression", compression).option("parquet.block.size", block_mb << 20)
    if bloom_bits:
        out = out.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(round(0.6185**bloom_bits, 6)))
    out.mode("overwrite").parquet(path)


LOG = "seq long, op string"


def open_store(spark: SparkSession, path: str, key: str = "string", value: str = "string", create_if_missing: bool = True, error_if_exists: bool = False, paranoid: bool = True) -> DataFrame:
    """The log at ``path``; without ``paranoid`` corrupt files are passed over."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    if there and error_if_exists:
        raise ValueError(f"{path} exists")
    schema = f"key {key}, {LOG}, value {value}"
    if not there:
        if not create_if_missing:
            raise ValueError(f"{path} does not exist")
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).option("ignoreCorruptFiles", str(not paranoid).lower()).parquet(path)


def repair(spark: SparkSession, path: str, to: str, partitions: int, key: str = "string", value: str = "string") -> DataFrame:
    """What can still be read of a log, written anew to ``to``."""
    write_sorted(open_store(spark, path, key, value, False, paranoid=False), to, partitions)
    return open_store(spark, to, key, value)


def destroy(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def approximate_size(log: DataFrame, low, high) -> DataFrame:
    """Bytes of the log's entries with key in [low, high)."""
    size = F.octet_length(F.col("key").cast("string")) + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))
    return log.where((F.col("key") >= low) & (F.col("key") < high)).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def statistics(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("entries"), F.sum((F.col("op") == "del").cast("long")).alias("tombstones"), F.countDistinct("key").alias("keys"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
