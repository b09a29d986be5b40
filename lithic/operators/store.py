"""The chunk store: containers, restore, deltas at rest, compaction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut
from .delta import apply_udf

CAP = 8 << 20


def pack(chunks: DataFrame, cap: int = CAP) -> DataFrame:
    """``(file_id, chunk_id, container_id, offset)`` by running size within a file.

    A chunk's container is the one in which it starts when containers are cut
    at multiples of ``cap``; a window over each file, no global order.
    """
    w = Window.partitionBy("file_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("chunk_len").over(w), F.lit(0))
    return chunks.select("file_id", "chunk_id", "fp", "chunk_len", F.floor(before / cap).cast("long").alias("container_id"), (before % cap).cast("long").alias("offset"))


#: Containers to a lane, on average: what one task fills in order.
PER_LANE = 16


def lane_count(chunks: DataFrame, cap: int = CAP) -> int:
    """Lanes for ``chunks(fp, chunk_len)``: they follow the bytes to pack."""
    total = chunks.groupBy("fp").agg(F.max("chunk_len").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return max(1, -(-total // (PER_LANE * cap)))


def pack_exact(chunks: DataFrame, cap: int = CAP, lanes: int | None = None) -> DataFrame:
    """``(fp, lane, container_id, offset, chunk_len)``: first chunks, packed greedily.

    A container takes chunks while they fit below ``cap``; then the next one
    opens. Ingest runs in ``lanes``, by default as many as the bytes ask for:
    chunks are dealt by fingerprint, a lane fills its own containers in order, and only two numbers are kept while it
    does, whatever its length.
    """
    lanes = lanes or lane_count(chunks, cap)
    rows = chunks.groupBy("fp").agg(F.max("chunk_len").alias("chunk_len"))
    rows = rows.withColumn("lane", (F.conv(F.substring("fp", 1, 8), 16, 10).cast("long") % lanes).cast("int"))
    return _fill(rows, cap)


def _fill(rows: DataFrame, cap: int) -> DataFrame:
    """Containers of ``rows(fp, lane, chunk_len)``, lane by lane in order of ``fp``."""
    rows = rows.select("fp", "lane", "chunk_len").repartition("lane").sortWithinPartitions("lane", "fp")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, container, used = None, 0, 0
        for pdf in batches:
            where, offset = [], []
            for now, n in zip(pdf["lane"], pdf["chunk_len"]):
                if now != lane:
                    lane, container, used = now, 0, 0
                if used and used + n >= cap:
                    container, used = container + 1, 0
                where.append(container)
                offset.append(used)
                used += n
            yield pdf.assign(container_id=where, offset=offset)[["fp", "lane", "container_id", "offset", "chunk_len"]]

    return rows.mapInPandas(fill, "fp string, lane int, container_id long, offset long, chunk_len int")


def live_sizes(packed: DataFrame) -> DataFrame:
    return packed.groupBy("lane", "container_id").agg(F.sum("chunk_len").alias("live_bytes"), F.count("*").alias("chunks"))


def compact(packed: DataFrame, live: DataFrame, below: int, cap: int = CAP) -> DataFrame:
    """The store after compaction: dead chunks go, containers whose live size is
    at most ``below`` are packed anew behind the others of their lane; a
    lane's last one stays."""
    kept = packed.join(live.select("fp").distinct(), "fp", "left_semi")
    sizes = live_sizes(kept)
    sizes = sizes.withColumn("last", F.max("container_id").over(Window.partitionBy("lane"))).withColumn("move", (F.col("live_bytes") <= below) & (F.col("container_id") < F.col("last")))
    marked = kept.join(sizes.select("lane", "container_id", "move", "last"), ["lane", "container_id"])
    stay = marked.where("not move").select("fp", "lane", "container_id", "offset", "chunk_len")
    lasts = sizes.groupBy("lane").agg(F.max("last").alias("top"))
    again = _fill(marked.where("move"), cap).join(lasts, "lane")
    return stay.unionByName(again.withColumn("container_id", F.col("container_id") + F.col("top") + 1).select("fp", "lane", "container_id", "offset", "chunk_len"))


def payload_store(chunks: DataFrame) -> DataFrame:
    """``(fp, data)``, each payload once."""
    return chunks.select("fp", "data").dropDuplicates(["fp"])


def apply_deltas(store: DataFrame, deltas: DataFrame) -> DataFrame:
    """``(fp, data, base_fp, delta, delta_depth)``: accepted deltas in place of payloads.

    A base keeps its payload, so restoring takes one step.
    """
    d = deltas.where("accepted").groupBy(F.col("new_fp").alias("fp")).agg(F.min(F.struct("base_fp", "delta")).alias("d"))
    bases = d.select(F.col("d.base_fp").alias("fp")).distinct()
    d = d.join(bases, "fp", "left_anti")
    rows = store.join(d, "fp", "left")
    return rows.select("fp", F.when(F.col("d").isNull(), F.col("data")).alias("data"), F.col("d.base_fp").alias("base_fp"), F.col("d.delta").alias("delta"), F.col("d").isNotNull().cast("int").alias("delta_depth"))


def resolve(store: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(fp, data)``: delta chains are followed, one join for each depth that occurs.

    Ends when no delta has its base any more; ``max_depth`` ends it earlier.
    """
    if "delta" not in store.columns:
        return store.select("fp", "data")
    done = step = store.where("delta is null").select("fp", "data")
    left = store.where("delta is not null").select("fp", "base_fp", "delta")
    depth = 0
    while max_depth is None or depth < max_depth:
        base = step.select(F.col("fp").alias("base_fp"), F.col("data").alias("base"))
        step = cut(left.join(base, "base_fp").select("fp", apply_udf("base", "delta").alias("data")))
        if step.isEmpty():
            break
        done = done.unionByName(step)
        left = cut(left.join(step.select("fp"), "fp", "left_anti"))
        depth += 1
        if left.isEmpty():
            break
    return done


def restore(recipes: DataFrame, store: DataFrame, first: int | None = None, last: int | None = None, max_depth: int | None = None) -> DataFrame:
    """``(file_id, version, content, complete)`` of recipe entries with chunk_id in
    [first, last); whole files by default. ``complete``: every chunk was found
    at its length."""
    want = recipes.select("file_id", "version", "chunk_id", "chunk_len", "fp")
    if first is not None:
        want = want.where(F.col("chunk_id") >= first)
    if last is not None:
        want = want.where(F.col("chunk_id") < last)
    rows = want.join(resolve(store, max_depth), "fp", "left")
    ok = F.min((F.coalesce(F.octet_length("data"), F.lit(-1)) == F.col("chunk_len")).cast("int")) == 1
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", F.hex("data").alias("h"))))
    whole = rows.groupBy("file_id", "version").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).alias("content"), ok.alias("complete"))
    return whole


def restore_parts(recipes: DataFrame, store: DataFrame, part: int = 64 << 20, max_depth: int | None = None) -> DataFrame:
    """``(file_id, version, part_no, byte_off, content, complete)``: files of any size, in parts.

    ``recipes`` must have ``byte_off``; a part holds the chunks that start in
    one stretch of ``part`` bytes, so that no row grows with the file. Parts
    are sorted within a file version.
    """
    rows = recipes.select("file_id", "version", "chunk_id", "byte_off", "chunk_len", "fp").join(resolve(store, max_depth), "fp", "left")
    ok = F.min((F.coalesce(F.octet_length("data"), F.lit(-1)) == F.col("chunk_len")).cast("int")) == 1
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", F.hex("data").alias("h"))))
    whole = rows.groupBy("file_id", "version", F.floor(F.col("byte_off") / part).alias("part_no"))
    whole = whole.agg(F.min("byte_off").alias("byte_off"), F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).alias("content"), ok.alias("complete"))
    return whole.repartition("file_id", "version").sortWithinPartitions("file_id", "version", "part_no")


def raw(recipes: DataFrame, store: DataFrame) -> DataFrame:
    """Stored bytes as they are, deltas not decoded."""
    return recipes.join(store, "fp")
