"""Changes between two versions of a file, chunk by chunk."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REGION = "array<struct<old_start:int,old_end:int,new_start:int,new_end:int,kind:string>>"


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(file_id, fp, status)``: each distinct fingerprint ``kept``, ``added`` or ``removed``."""
    a = old.select("file_id", "fp").distinct().withColumn("in_old", F.lit(True))
    b = new.select("file_id", "fp").distinct().withColumn("in_new", F.lit(True))
    status = F.when(F.col("in_old") & F.col("in_new"), "kept").when(F.col("in_new"), "added").otherwise("removed")
    return a.join(b, ["file_id", "fp"], "full_outer").select("file_id", "fp", status.alias("status"))


def anchors(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(file_id, old_id, new_id)``: chunks that stand once in either version,
    those that come after all earlier ones in both."""
    once = lambda df, name: df.groupBy("file_id", "fp").agg(F.count("*").alias("n"), F.min("chunk_id").alias(name)).where("n = 1").drop("n")
    both = once(old, "old_id").join(once(new, "new_id"), ["file_id", "fp"])
    before = Window.partitionBy("file_id").orderBy("old_id").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("top", F.max("new_id").over(before)).where("top is null or new_id > top").select("file_id", "old_id", "new_id")


def anchor_regions(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(file_id, old_start, old_end, new_start, new_end, kind)``: the gaps between anchors.

    Ranges are inclusive; an empty side has end = start - 1 and makes the
    region an ``insert`` or a ``delete``, else it is a ``modify``.
    """
    size = lambda df, name: df.groupBy("file_id").agg((F.max("chunk_id") + 1).alias(name))
    ends = size(old, "old_id").join(size(new, "new_id"), "file_id", "full_outer")
    ends = ends.select("file_id", F.coalesce("old_id", F.lit(0)).alias("old_id"), F.coalesce("new_id", F.lit(0)).alias("new_id"))
    points = anchors(old, new).unionByName(ends)
    w = Window.partitionBy("file_id").orderBy("old_id", "new_id")
    gap = points.select("file_id", (F.coalesce(F.lag("old_id").over(w), F.lit(-1)) + 1).alias("old_start"), (F.col("old_id") - 1).alias("old_end"), (F.coalesce(F.lag("new_id").over(w), F.lit(-1)) + 1).alias("new_start"), (F.col("new_id") - 1).alias("new_end"))
    no_old, no_new = F.col("old_end") < F.col("old_start"), F.col("new_end") < F.col("new_start")
    return gap.where(~(no_old & no_new)).withColumn("kind", F.when(no_old, "insert").when(no_new, "delete").otherwise("modify"))


def kind(n_old: int, n_new: int) -> str:
    return "modify" if n_old and n_new else "insert" if n_new else "delete"


def sliding_regions(old: list[str], new: list[str], least: int, most: int) -> list[tuple[int, int, int, int, str]]:
    """Regions by a sliding window that resynchronises on equal chunks.

    At a difference the window looks ahead, for each new chunk in turn, for an
    equal old one; the first pair found ends the region. Where a whole window
    fails it widens, the old cursor takes the new cursor's place, be that
    ahead or back, and the region stays open until chunks agree again or the
    files end. A region whose old side ends before it starts has none.
    """
    i = j = 0
    out: list[tuple[int, int, int, int, str]] = []
    width, opened = least, None

    def close(i: int, j: int) -> None:
        nonlocal opened, width
        si, sj = opened
        end = max(i, si)
        if end > si or j > sj:
            out.append((si, end - 1, sj, j - 1, kind(end - si, j - sj)))
        opened, width = None, least

    while i < len(old) and j < len(new):
        if old[i] == new[j]:
            if opened:
                close(i, j)
            i, j, width = i + 1, j + 1, least
            continue
        opened = opened or (i, j)
        ahead = {}
        for k in range(min(width, len(old) - i) - 1, -1, -1):
            ahead[old[i + k]] = k
        hit = next(((d, ahead[new[j + d]]) for d in range(min(width, len(new) - j)) if new[j + d] in ahead), None)
        if hit:
            j, i = j + hit[0], i + hit[1]
            close(i, j)
        else:
            j = min(len(new), j + width)
            i, width = min(len(old), j), most
    opened = opened or ((min(i, len(old)), j) if i < len(old) or j < len(new) else None)
    if opened:
        close(len(old), len(new))
    return out


def sliding_window_regions(old: DataFrame, new: DataFrame, window: tuple[int, int] = (48, 256)) -> DataFrame:
    """The exact scan, one file version pair at a time; rows as ``anchor_regions``.

    Fingerprints only: a file's chunk list is what a row holds.
    """
    fps = lambda df, name: df.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "fp"))), lambda x: x["fp"]).alias(name))
    both = fps(old, "a").join(fps(new, "b"), "file_id", "full_outer").select("file_id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in "ab"])

    @F.pandas_udf(REGION)
    def scan(a: pd.Series, b: pd.Series) -> pd.Series:
        names = ("old_start", "old_end", "new_start", "new_end", "kind")
        return pd.Series([[dict(zip(names, r)) for r in sliding_regions(list(x), list(y), *window)] for x, y in zip(a, b)])

    return both.select("file_id", F.inline(scan("a", "b")))


def positional_pairs(regions: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """``(file_id, base_fp, new_fp)``: first with first and last with last chunk
    of every modified region of two chunks or more, or of one each; only where
    the new chunk is unique (``new.is_unique``)."""
    n_old, n_new = F.col("old_end") - F.col("old_start") + 1, F.col("new_end") - F.col("new_start") + 1
    first, last = F.struct(F.col("old_start").alias("o"), F.col("new_start").alias("n")), F.struct(F.col("old_end").alias("o"), F.col("new_end").alias("n"))
    pairs = F.when((n_old >= 2) & (n_new >= 2), F.array(first, last)).when((n_old == 1) & (n_new == 1), F.array(first))
    rows = regions.where("kind = 'modify'").select("file_id", F.inline(pairs))
    a = old.select("file_id", F.col("chunk_id").alias("o"), F.col("fp").alias("base_fp"))
    b = new.where("is_unique").select("file_id", F.col("chunk_id").alias("n"), F.col("fp").alias("new_fp"))
    return rows.join(a, ["file_id", "o"]).join(b, ["file_id", "n"]).select("file_id", "base_fp", "new_fp")


def interior_chunks(regions: DataFrame, new: DataFrame) -> DataFrame:
    """Unique new chunks strictly within a region: ``(file_id, chunk_id, fp)``.

    The range is unfolded to chunk numbers, so the join is an equi-join.
    """
    inside = regions.where("new_end - new_start >= 2").select("file_id", F.explode(F.sequence(F.col("new_start") + 1, F.col("new_end") - 1)).alias("chunk_id"))
    return inside.join(new.where("is_unique"), ["file_id", "chunk_id"]).select("file_id", "chunk_id", "fp")


def region_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bytes only in the old version, only in the new one, and in both, by file."""
    a = old.groupBy("file_id", "fp").agg(F.sum("chunk_len").alias("old_len"))
    b = new.groupBy("file_id", "fp").agg(F.sum("chunk_len").alias("new_len"))
    both = a.join(b, ["file_id", "fp"], "full_outer")
    total = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("long")
    return both.groupBy("file_id").agg(total("old_len", F.col("new_len").isNull()).alias("old_only"), total("new_len", F.col("old_len").isNull()).alias("new_only"), total("new_len", F.col("old_len").isNotNull() & F.col("new_len").isNotNull()).alias("kept"))


def unmatched_segments(old: DataFrame, new: DataFrame) -> DataFrame:
    """New segments whose hash the old version of the file lacks: the rest is pruned."""
    return new.join(old.select("file_id", "hash"), ["file_id", "hash"], "left_anti")


def pruned_diff(old_segments: DataFrame, new_segments: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """``chunk_diff`` of what lies in changed segments only."""
    inside = lambda seg, chunks: seg.select("file_id", F.explode(F.sequence("start_chunk_id", "end_chunk_id")).alias("chunk_id")).join(chunks, ["file_id", "chunk_id"])
    return chunk_diff(inside(unmatched_segments(new_segments, old_segments), old), inside(unmatched_segments(old_segments, new_segments), new))


def detect(old: DataFrame, new: DataFrame, mode: str = "anchor", window: tuple[int, int] = (48, 256)) -> DataFrame:
    """Regions by ``anchor`` or by ``window``."""
    if mode not in ("anchor", "window"):
        raise ValueError(f"unknown mode {mode!r}")
    return anchor_regions(old, new) if mode == "anchor" else sliding_window_regions(old, new, window)
