"""Similarity: features, super-features and groups of similar chunks.

Features are maxima of window hashes, so small edits leave most of them as
they are; super-features hash groups of features, so that chunks which share
one are similar with high probability. No feature values are fixed by any
format: what holds are their properties.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut

WINDOW = 48
_MULTIPLY, _ADD = (np.random.default_rng(48).integers(1, 2**32, 64, dtype=np.uint64) | np.uint64(1) for _ in range(2))


def window_hashes(b: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A 32-bit hash of every window; of all bytes if they are fewer."""
    w = min(window, len(b))
    if not w:
        return np.zeros(1, np.uint64)
    powers = np.multiply.accumulate(np.full(len(b), 0x01000193, np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers)])
    inverse = np.multiply.accumulate(np.full(len(b), pow(0x01000193, -1, 2**64), np.uint64))
    h = (sums[w:] - sums[:-w]) * inverse[: len(b) - w + 1]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint64)


def ntransform(b: np.ndarray, n: int) -> list[int]:
    """n features: the maximum of each of n linear transforms of the hashes."""
    h = window_hashes(b)
    return [int(((_MULTIPLY[i] * h + _ADD[i]) & np.uint64(0xFFFFFFFF)).max()) for i in range(n)]


def finesse(b: np.ndarray, n: int) -> list[int]:
    """n features: the largest hash of each of n equal parts."""
    edges = [len(b) * i // n for i in range(n + 1)]
    return [int(window_hashes(b[x:y]).max()) for x, y in zip(edges, edges[1:])]


EXTRACTORS: dict[str, Callable[[np.ndarray, int], list[int]]] = {"ntransform": ntransform, "finesse": finesse}


def features(data: Column, method: str = "finesse", n: int = 16, prefix: int | None = None) -> Column:
    """``array<long>`` of whole chunks, or of their first ``prefix`` bytes."""
    extract = EXTRACTORS[method]

    @F.pandas_udf("array<long>")
    def udf(batch: pd.Series) -> pd.Series:
        return pd.Series([extract(np.frombuffer(x or b"", np.uint8), n) for x in batch])

    return udf(data if prefix is None else F.substring(data, 1, prefix))


def super_features(feats: Column, n: int, method: str = "finesse") -> Column:
    """``array<string>`` of n super-features, n a divisor of the features' number.

    N-transform: runs of features. Finesse: features are ranked within groups
    of n, and super-feature r hashes what stands at rank r in every group.
    """
    each = (F.size(feats) / n).cast("int")
    if method == "ntransform":
        part = lambda r: F.slice(feats, r * each + 1, each)
    else:
        part = lambda r: F.transform(F.sequence(F.lit(0), each - 1), lambda g: F.get(F.sort_array(F.slice(feats, g * n + 1, F.lit(n))), r))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.md5(F.array_join(F.transform(part(r), lambda x: x.cast("string")), ",").cast("binary")))


def sketches(chunks: DataFrame, n: int = 4, method: str = "finesse", prefix: int | None = None) -> DataFrame:
    """``(fp, sf array<string>)`` for each distinct chunk of ``(fp, data)``."""
    data = F.col("data") if prefix is None else F.substring("data", 1, prefix)
    once = chunks.select("fp", data.alias("data")).dropDuplicates(["fp"])
    feats = once.select("fp", features(F.col("data"), method, 4 * n).alias("f"))
    return feats.select("fp", super_features(F.col("f"), n, method).alias("sf"))


def groups(sketch: DataFrame, n: int, overlapping: bool = False) -> DataFrame:
    """``(group_sf, sf_pos, member_fp, base_fp)``: chunks that share a super-feature.

    Positions are gone through in order. A chunk joins the group of the first
    position where it has company (among chunks not yet grouped, unless
    ``overlapping``); the base is the least fingerprint. A group stays a set
    of rows, however large it is.
    """
    sketch = cut(sketch)  # features come from Python; each position reads them again
    out, left = None, sketch
    for pos in range(n):
        at = (sketch if overlapping else left).select(F.col("fp").alias("member_fp"), F.get("sf", pos).alias("group_sf")).where("group_sf is not null")
        base = at.groupBy("group_sf").agg(F.count("*").alias("n"), F.min("member_fp").alias("base_fp")).where("n > 1").drop("n")
        part = cut(at.join(base, "group_sf").select("group_sf", F.lit(pos).alias("sf_pos"), "member_fp", "base_fp"))
        out = part if out is None else out.unionByName(part)
        if not overlapping and pos + 1 < n:
            left = left.join(part.select(F.col("member_fp").alias("fp")), "fp", "left_anti")
    return out
