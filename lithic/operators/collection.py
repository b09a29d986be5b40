"""Collections: find, insert, update, replace, delete, bulk writes, grid files.

A collection is a DataFrame; a write returns the next version of it.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..options import Options
from .chunking import chunks
from .stages import condition, expression, run

GRID_CHUNK = 255 * 1024


def find(df: DataFrame, filter_: dict | None = None, projection: list[str] | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0, low: dict | None = None, high: dict | None = None, collation: str | None = None, record_id: bool = False) -> DataFrame:
    """``low`` is inclusive, ``high`` exclusive; a limit of 0 is none.

    Under a collation strings are compared and sorted by it; ``record_id``
    adds a number to each row, the same as long as the table is.
    """
    out = df.withColumn("record_id", F.monotonically_increasing_id()) if record_id else df
    out = out.where(condition(filter_ or {}, collation))
    for k, v in (low or {}).items():
        out = out.where(F.col(k) >= v)
    for k, v in (high or {}).items():
        out = out.where(F.col(k) < v)
    if sort:
        text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)} if collation else set()
        by = {k: F.collate(F.col(k), collation) if k in text else F.col(k) for k in sort}
        out = out.orderBy(*[by[k].asc() if v == 1 else by[k].desc() for k, v in sort.items()])
    out = out.offset(skip) if skip else out
    out = out.limit(limit) if limit else out
    return out.select(*projection, *(["record_id"] if record_id else [])) if projection else out


def find_one(df: DataFrame, filter_: dict | None = None, sort: dict | None = None) -> DataFrame:
    return find(df, filter_, sort=sort, limit=1)


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def _seed(df: DataFrame, filter_: dict, sets: dict[str, Any]) -> DataFrame:
    """The row that an upsert adds if nothing meets the filter: its equal fields, then ``sets``."""
    fields = {k: F.lit(v) for k, v in filter_.items() if not k.startswith("$") and not isinstance(v, dict)} | {k: expression(v) for k, v in sets.items()}
    kind = {f.name: f.dataType for f in df.schema.fields}
    one = df.sparkSession.range(1).select(*[(fields[c] if c in fields else F.lit(None)).cast(kind[c]).alias(c) for c in df.columns], *[v.alias(k) for k, v in fields.items() if k not in kind])
    hit = df.where(condition(filter_)).limit(1).select(F.lit(1).alias("_hit"))
    return one.withColumn("_hit", F.lit(1)).join(hit, "_hit", "left_anti").drop("_hit")


def update_many(df: DataFrame, filter_: dict, sets: dict[str, Any], upsert: bool = False) -> DataFrame:
    """All hits changed; with ``upsert`` a new row if there are none."""
    hit = condition(filter_)
    out = df.withColumns({k: F.when(hit, expression(v)).otherwise(F.col(k)) if k in df.columns else F.when(hit, expression(v)) for k, v in sets.items()})
    return out.unionByName(_seed(df, filter_, sets), allowMissingColumns=True) if upsert else out


def update_pipeline(df: DataFrame, filter_: dict, stages: list[dict]) -> DataFrame:
    """The hits as ``$set``, ``$project`` and ``$replaceRoot`` stages make them; the rest as it is."""
    hit = condition(filter_)
    return df.where(~hit).unionByName(run(df.where(hit), stages), allowMissingColumns=True)


def update_elements(df: DataFrame, array: str, test, change) -> DataFrame:
    """Change the elements of an array that pass a test (array filters)."""
    return df.withColumn(array, F.transform(array, lambda x: F.when(test(x), change(x)).otherwise(x)))


def update_one(df: DataFrame, filter_: dict, sets: dict[str, Any], key: str, upsert: bool = False) -> DataFrame:
    """The first hit by key."""
    first = df.where(condition(filter_)).agg(F.min(key).alias("_first"))
    hit = F.coalesce(F.col(key) == F.col("_first"), F.lit(False))
    rows = df.join(F.broadcast(first))  # one row
    out = rows.withColumns({k: F.when(hit, expression(v)).otherwise(F.col(k)) if k in df.columns else F.when(hit, expression(v)) for k, v in sets.items()}).drop("_first")
    return out.unionByName(_seed(df, filter_, sets), allowMissingColumns=True) if upsert else out


def replace(df: DataFrame, rows: DataFrame, key: str, upsert: bool = True) -> DataFrame:
    """Rows of the same key replaced; others added if ``upsert``."""
    new = rows if upsert else rows.join(df.select(key), key, "left_semi")
    return df.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_many(df: DataFrame, filter_: dict) -> DataFrame:
    return df.where(~condition(filter_))


def delete_one(df: DataFrame, filter_: dict, key: str) -> DataFrame:
    first = df.where(condition(filter_)).agg(F.min(key).alias(key))
    return df.join(F.broadcast(first), key, "left_anti")


def find_one_and(df: DataFrame, after: DataFrame, filter_: dict, key: str, new: bool = False) -> DataFrame:
    """The first hit by key, as it was before a write or as it is after."""
    first = df.where(condition(filter_)).agg(F.min(key).alias(key))
    return (after if new else df).join(F.broadcast(first), key, "left_semi")


def count_documents(df: DataFrame, filter_: dict | None = None) -> DataFrame:
    return df.where(condition(filter_ or {})).agg(F.count("*").alias("n"))


def distinct(df: DataFrame, field: str, filter_: dict | None = None) -> DataFrame:
    """Distinct values; of an array, of its elements."""
    rows = df.where(condition(filter_ or {}))
    value = F.explode(field) if rows.schema[field].dataType.typeName() == "array" else F.col(field)
    return rows.select(value.alias("value")).distinct()


def bulk(df: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """An ordered bulk write ``(key, at, op, ...)``, op put or del: the last one of a key wins."""
    values = [c for c in df.columns if c != key]
    last = writes.groupBy(key).agg(F.max(F.struct("at", "op", *values)).alias("w"))
    put = last.where("w.op = 'put'").select(key, *[F.col(f"w.{c}").alias(c) for c in values])
    return df.join(last.select(key), key, "left_anti").unionByName(put)


def bulk_write(df: DataFrame, models: list[tuple], key: str) -> DataFrame:
    """Write models in order: ``("insert_one", row)``, ``("update_one", filter, sets[, upsert])``,
    ``("update_many", filter, sets[, upsert])``, ``("replace_one", row[, upsert])``,
    ``("delete_one", filter)``, ``("delete_many", filter)``. Rows are dicts."""
    one = lambda row: df.sparkSession.createDataFrame([tuple(row.get(c) for c in df.columns)], df.schema)
    for kind, *args in models:
        if kind == "insert_one":
            df = insert(df, one(*args))
        elif kind == "update_one":
            df = update_one(df, *args[:2], key, *args[2:])
        elif kind == "update_many":
            df = update_many(df, *args)
        elif kind == "replace_one":
            df = replace(df, one(args[0]), key, *(args[1:] or [False]))
        elif kind == "delete_one":
            df = delete_one(df, args[0], key)
        elif kind == "delete_many":
            df = delete_many(df, args[0])
        else:
            raise ValueError(f"unknown write model {kind}")
    return df


def estimated_count(spark: SparkSession, path: str) -> int:
    """Rows by the files' footers alone: no column is read."""
    return spark.read.parquet(path).count()


def capped(df: DataFrame, size: int, order: str) -> DataFrame:
    """What a collection of at most ``size`` rows keeps: the last by ``order``."""
    return df.orderBy(F.desc(order)).limit(size)


def unique_violations(df: DataFrame, *keys: str) -> DataFrame:
    """What a unique index would refuse."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unexpired(df: DataFrame, ts: str, seconds: int, now) -> DataFrame:
    """What an expiring index would leave."""
    return df.where(F.col(ts) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {seconds} SECONDS"))


def validated(df: DataFrame, rule: dict) -> DataFrame:
    """The rows; an error if one breaks the rule."""
    return df.where(F.when(condition(rule), True).otherwise(F.raise_error(F.lit("a row breaks the validator")).cast("boolean")))


def grid_upload(files: DataFrame, chunk: int = GRID_CHUNK) -> DataFrame:
    """``(file_id, n, chunk_len, data)``: pieces of 255 KiB."""
    rows = chunks(files, Options(chunking="fixed", min_chunk=chunk, avg_chunk=chunk, max_chunk=chunk))
    return rows.select("file_id", F.col("chunk_id").alias("n"), "chunk_len", "data")


def grid_download(pieces: DataFrame) -> DataFrame:
    """``(file_id, content)``."""
    parts = F.array_sort(F.collect_list(F.struct("n", F.hex("data").alias("h"))))
    return pieces.groupBy("file_id").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).alias("content"))


def grid_find(pieces: DataFrame, filter_: dict | None = None) -> DataFrame:
    """``(file_id, length, chunks)`` of the files, or of those that pass a filter on these."""
    files = pieces.groupBy("file_id").agg(F.sum("chunk_len").alias("length"), F.count("*").alias("chunks"))
    return files.where(condition(filter_ or {}))


def grid_delete(pieces: DataFrame, gone: DataFrame) -> DataFrame:
    """The pieces without those of the files in ``gone(file_id)``."""
    return pieces.join(gone.select("file_id"), "file_id", "left_anti")
