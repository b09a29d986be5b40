"""Chunking, and the index levels above chunks.

Content-defined cuts need the rolling hash of every window. Modulo 2**16 the
powers of 257 are 1 + 256 k, so the hash of a window is the sum of its bytes
plus 256 times the sum of byte times distance from its end: two differences
of prefix sums, whatever the chunk's start. Candidates are found for a whole
file at once; only picking among these few goes from cut to cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fingerprint
from ..options import Options


def candidate_ends(b: np.ndarray, window: int, bits: int) -> np.ndarray:
    """End positions (exclusive) whose window hash has ``bits`` low zero bits."""
    n = len(b)
    if n < window:
        return np.empty(0, np.int64)
    x = b.astype(np.int64)
    s1 = np.concatenate([[0], np.cumsum(x)])
    si = np.concatenate([[0], np.cumsum(x * np.arange(n))])
    end = np.arange(window, n + 1)
    w1, wi = s1[end] - s1[end - window], si[end] - si[end - window]
    return end[((w1 + 256 * ((end - 1) * w1 - wi)) & ((1 << bits) - 1)) == 0]


def cut_points(b: np.ndarray, options: Options) -> list[int]:
    """Chunk ends of one file, in order; none for an empty file."""
    n, at, ends = len(b), 0, []
    found = candidate_ends(b, options.rolling_window, options.mask_bits)
    least = max(options.min_chunk, options.rolling_window + 1)
    while at < n:
        i = np.searchsorted(found, at + least)
        at = min(n, at + options.max_chunk, int(found[i]) if i < len(found) else n)
        ends.append(at)
    return ends


def chunks(files: DataFrame, options: Options, payload: bool = True) -> DataFrame:
    """``(file_id, version, chunk_id, byte_off, chunk_len, fp[, data])``.

    Only the cut positions of content-defined chunking come from Python; the
    bytes are sliced and hashed in the JVM.
    """
    data = F.col("content")
    if options.chunking == "fixed":
        size = options.avg_chunk
        n = F.octet_length(data)
        ends = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.ceil(n / size).cast("int")), lambda i: F.least(i * size, n))).otherwise(F.array().cast("array<int>"))
    else:

        @F.pandas_udf("array<int>")
        def cuts(batch: pd.Series) -> pd.Series:
            return pd.Series([cut_points(np.frombuffer(x or b"", np.uint8), options) for x in batch])

        ends = cuts(data)
    cut = files.withColumn("_ends", ends)
    start = lambda i: F.when(i > 0, F.get(F.col("_ends"), i - 1)).otherwise(0)
    each = F.transform("_ends", lambda e, i: F.struct(i.alias("chunk_id"), start(i).cast("long").alias("byte_off"), (e - start(i)).alias("chunk_len"), F.substring(data, start(i) + 1, e - start(i)).alias("data")))
    rows = cut.select("file_id", "version", F.inline(each))
    columns = ["file_id", "version", "chunk_id", "byte_off", "chunk_len", fingerprint(F.col("data"), options.nul_safe).alias("fp")]
    return rows.select(*columns, *(["data"] if payload else []))


def closes(first_byte: int, tail_zero: bool, size: int, least: int, most: int, divisor: int) -> bool:
    """Whether a child ends its group; ``size`` is the group's without it."""
    if size < least:
        return False
    return size > most or first_byte & (divisor - 1) == divisor - 1 or tail_zero


def group_ids(fps: list[str], sizes: list[int], limits: tuple[int, int, int], divisor: int, group: int = 0, size: int = 0) -> tuple[list[int], int, int]:
    """The group of each child, in order, and where the next child would go on.

    The child that closes a group belongs to it.
    """
    out = []
    for fp, n in zip(fps, sizes):
        out.append(group)
        tail = bytes.fromhex(fp)[-9:] == b"0" * 9
        if closes(int(fp[:2], 16), tail, size, limits[0], limits[2], divisor):
            group, size = group + 1, 0
        else:
            size += n
    return out, group, size


def _level(children: DataFrame, child: str, name: str, size: str, limits: tuple[int, int, int], divisor: int) -> DataFrame:
    """Groups of consecutive children of each file version.

    A task goes through a file's children in order, batch by batch, with two
    numbers in hand; only a group's fingerprints are ever gathered.
    """
    kind = {f.name: f.dataType.simpleString() for f in children.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group, used = None, 0, 0
        for pdf in batches:
            for now, part in pdf.groupby(["file_id", "version"], sort=False, dropna=False):
                if now != key:
                    key, group, used = now, 0, 0
                ids, group, used = group_ids(part["fp"].tolist(), part["size"].tolist(), limits, divisor, group, used)
                yield part.assign(**{name: ids})

    rows = children.select("file_id", "version", child, "fp", F.col(size).cast("long").alias("size"))
    rows = rows.repartition("file_id", "version").sortWithinPartitions("file_id", "version", child)
    rows = rows.mapInPandas(run, f"file_id {kind['file_id']}, version {kind['version']}, {child} {kind[child]}, fp string, size long, {name} int")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(child, "fp"))), lambda x: x["fp"]), "")
    return rows.groupBy("file_id", "version", name).agg(F.min(child).alias(f"start_{child}"), F.max(child).alias(f"end_{child}"), F.sum("size").alias("size"), F.sha2(F.unhex(joined), 256).alias("hash"))


def segments(chunk_index: DataFrame, options: Options) -> DataFrame:
    """``(file_id, version, segment_id, start_chunk_id, end_chunk_id, size, hash)``.

    Files are independent of each other.
    """
    return _level(chunk_index, "chunk_id", "segment_id", "chunk_len", options.segment, 64)


def containers(segment_index: DataFrame, options: Options) -> DataFrame:
    """The level above segments; its size limit closes a group once reached."""
    least = options.container_group[0]
    return _level(segment_index.withColumnRenamed("hash", "fp"), "segment_id", "container_id", "size", (least, least, least), 256)


def chunking(files: DataFrame, options: Options) -> dict[str, DataFrame]:
    """The three index levels by name."""
    flat = chunks(files, options, payload=False)
    seg = segments(flat, options)
    return {"chunks": flat, "segments": seg, "containers": containers(seg, options)}


def block_chunks(blocks: DataFrame, options: Options) -> DataFrame:
    """Content-defined chunks of files that come in blocks, of any size together.

    ``blocks(file_id, version, block_no, content)``; columns as in ``chunks``
    with payload. A task reads a file block by block and keeps only what lies
    after its last cut, less than ``max_chunk`` bytes, beside the block.
    """
    kind = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rest, no, off = None, b"", 0, 0

        def take(data: bytes, last: bool) -> pd.DataFrame:
            nonlocal rest, no, off
            ends = cut_points(np.frombuffer(data, np.uint8), options)
            if not last and ends:  # the end of the data is no end of the file: what stands there waits
                ends.pop()
            starts = [0, *ends[:-1]] if ends else []
            out = pd.DataFrame([(*key, no + i, off + a, b - a, data[a:b]) for i, (a, b) in enumerate(zip(starts, ends))], columns=columns)
            done = ends[-1] if ends else 0
            rest, no, off = data[done:], no + len(ends), off + done
            return out

        columns = ["file_id", "version", "chunk_id", "byte_off", "chunk_len", "data"]
        for pdf in batches:
            for file_id, version, content in zip(pdf["file_id"], pdf["version"], pdf["content"]):
                if key != (file_id, version):
                    if key is not None and rest:
                        yield take(rest, True)
                    key, rest, no, off = (file_id, version), b"", 0, 0
                yield take(rest + (content or b""), False)
        if key is not None and rest:
            yield take(rest, True)

    rows = blocks.repartition("file_id", "version").sortWithinPartitions("file_id", "version", "block_no").select("file_id", "version", "content")
    cut = rows.mapInPandas(run, f"file_id {kind['file_id']}, version {kind['version']}, chunk_id int, byte_off long, chunk_len int, data binary")
    return cut.select("file_id", "version", "chunk_id", "byte_off", "chunk_len", fingerprint(F.col("data"), options.nul_safe).alias("fp"), "data")
