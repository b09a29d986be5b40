"""Approximate nearest neighbours: multi-index hashing over learned codes.

A rotation is learned on a bounded sample (``sample_rows``): principal axes,
then iterative quantisation, so that the signs of a rotated vector are bits of
a code; further bits are signs under random rotations of the same axes, to
``BITS`` in all. Every row is coded and indexed, once: each shard cuts its
codes into substrings of 16 bits and keeps one index for each, from the
substrings that occur to their rows. By the pigeonhole principle a code within
Hamming distance r of the query's has a substring within ``r // PARTS`` of the
query's, so probing those buckets retrieves every code within r. Buckets are
probed by listing the near substrings, or, where those outnumber the buckets
that there are, by going through the buckets. The full distance is then
checked, and what remains is ranked by its exact inner product on the original
vectors in double precision.

The radius is learned too: on the sample, the distance within which
``coverage`` of the true neighbours fall. While a query has fewer than k rows,
a shard widens it until there are k.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read
from .grid import merge, search, usable

BITS, WIDTH = 256, 16
PARTS = BITS // WIDTH
TOGETHER = 256


def fit_rotation(x: np.ndarray, seed: int = 7, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection of d x ``BITS``): principal axes rotated to fit their signs, then random rotations of them."""
    rng, d = np.random.default_rng(seed), max(1, x.shape[1])
    mean = x.mean(0)
    some = min(d, BITS)
    axes = np.eye(d)[:, :some]
    turns = [np.linalg.qr(rng.normal(size=(some, some)))[0] for _ in range(-(-BITS // some))]
    if len(x) > 1 and x.shape[1]:
        y = x - mean
        axes = np.linalg.eigh(y.T @ y)[1][:, ::-1][:, :some]
        z = y @ axes
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(z @ turns[0] >= 0, 1.0, -1.0).T @ z)
            turns[0] = (u @ vt).T
    return mean, np.concatenate([axes @ r for r in turns], 1)[: x.shape[1], :BITS]


def code(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """``BITS`` bits of each row, as words of 64."""
    return np.packbits(x @ projection >= 0, axis=1).view(np.uint64).reshape(len(x), BITS // 64)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of codes, over the last axis."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def fit(x: np.ndarray, k: int, coverage: float, rows: int) -> dict:
    """Mean, projection and radius, learned on the sample ``x`` of ``rows`` rows.

    The k nearest of all rows lie as near as the k * len(x) / rows nearest of
    the sample; these set the radius.
    """
    k = max(1, -(-k * len(x) // max(1, rows)))
    mean, p = fit_rotation(x)
    c, radius = code(x - mean, p), BITS
    q = np.arange(0, len(x), max(1, len(x) // 512))
    if len(x) > k:
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -np.inf
        near = np.argpartition(-s, k, axis=1)[:, :k]
        radius = int(np.quantile(apart(c[q][:, None], c[near]), coverage))
    return {"mean": mean, "projection": p, "radius": radius}


def model_of(models: dict[int, dict], dim: int) -> dict:
    """A length that the sample lacks has no learned radius: all its rows are near."""
    if dim not in models:
        mean, p = fit_rotation(np.zeros((1, dim)))
        models[dim] = {"mean": mean, "projection": p, "radius": BITS}
    return models[dim]


@cache
def near_masks(radius: int) -> np.ndarray:
    """All differences of a substring in ``radius`` bits at most."""
    all_ = np.arange(1 << WIDTH, dtype=np.uint16)
    return all_[np.bitwise_count(all_) <= radius]


def indexer(models: dict[int, dict]):
    """The index of one shard: codes, and for each substring its buckets and each row's bucket."""

    def build(x: np.ndarray):
        model = model_of(models, x.shape[1])
        c = code(x - model["mean"], model["projection"])
        parts = c.view(np.uint16).reshape(len(x), PARTS)
        return c, [np.unique(parts[:, j], return_inverse=True) for j in range(PARTS)]

    return build


def probed(parts: np.ndarray, index: list[tuple[np.ndarray, np.ndarray]], radius: int) -> np.ndarray:
    """Which rows have a substring within ``radius // PARTS`` of the query's: queries x rows."""
    r = min(WIDTH, radius // PARTS)
    probes = sum(comb(WIDTH, i) for i in range(r + 1))
    hit = np.zeros((len(parts), len(index[0][1])), bool)
    for j, (buckets, of_row) in enumerate(index):
        if probes * 8 < len(buckets):
            wanted = parts[:, j, None] ^ near_masks(r)
            at = np.minimum(np.searchsorted(buckets, wanted), len(buckets) - 1)
            near = np.zeros((len(parts), len(buckets)), bool)
            q, i = np.nonzero(buckets[at] == wanted)
            near[q, at[q, i]] = True
        else:
            near = np.bitwise_count(parts[:, j, None] ^ buckets) <= r
        hit |= near[:, of_row]
    return hit


def prober(models: dict[int, dict]):
    """The finder of one shard, see ``grid.search``."""

    def find(q_rids, q, floor, best, scores, rids, ids, x, index):
        if len(q) > TOGETHER:
            out = [find(q_rids[lo : lo + TOGETHER], q[lo : lo + TOGETHER], floor[lo : lo + TOGETHER], best[lo : lo + TOGETHER], scores[lo : lo + TOGETHER], rids, ids, x, index) for lo in range(0, len(q), TOGETHER)]
            return np.concatenate([b for b, _ in out]), np.concatenate([s for _, s in out])
        model = model_of(models, x.shape[1])
        c, tables = index
        qc = code(q - model["mean"], model["projection"])
        parts = qc.view(np.uint16).reshape(len(q), PARTS)
        k, todo, radius = best.shape[1], np.arange(len(q)), model["radius"]
        enough = np.where(floor > -np.inf, 0, np.minimum(k - (scores > -np.inf).sum(1), (q_rids[:, None] != rids).sum(1)))
        best, scores = best.copy(), scores.copy()
        while len(todo):
            a, b = np.nonzero(probed(parts[todo], tables, radius))
            ok = (apart(qc[todo[a]], c[b]) <= radius) & (q_rids[todo[a]] != rids[b])
            a, b = a[ok], b[ok]
            done = (np.bincount(a, minlength=len(todo)) >= enough[todo]) | (radius >= BITS)
            keep = done[a]
            a, b = a[keep], b[keep]
            score = np.einsum("ij,ij->i", q[todo[a]], x[b])
            keep = score >= np.maximum(floor, scores[:, -1])[todo[a]]
            a, b, score = a[keep], b[keep], score[keep]
            n = np.bincount(a, minlength=len(todo))
            new = np.full((len(todo), max(1, n.max(initial=0))), -np.inf)
            got = np.full(new.shape, np.iinfo(np.int64).max)
            col = np.arange(len(a)) - np.concatenate([[0], np.cumsum(n)])[a]
            new[a, col], got[a, col] = score, ids[b]
            at = todo[n > 0]
            best[at], scores[at] = merge(best[at], scores[at], got[n > 0], new[n > 0])
            todo, radius = todo[~done], min(BITS, radius + PARTS)
        return best, scores

    return find


def nearest(vectors: DataFrame, asks: Column, k: int = 20, sample_rows: int = 4096, coverage: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row for which ``asks`` holds.

    The model is fitted on about ``sample_rows`` rows, chosen by a hash of
    their number; every row is indexed. Zero vectors take no part; other
    columns, of any name, take no part; nulls, repeated ids, lengths and empty
    tables: see ``grid``.
    """
    prepare(vectors.sparkSession)
    rows = usable(vectors.where(F.exists(vec_col, lambda x: x != 0)), asks, id_col, vec_col)
    n = rows.count()
    sample = rows.where(F.pmod(F.xxhash64("rid"), F.lit(max(1, n))) < sample_rows).select("v").toPandas()
    models = {d: fit(np.array(list(part["v"]), np.float64), k, coverage, n) for d, part in sample.groupby(sample["v"].map(len))}
    return search(rows, k, indexer(models), prober(models), "double")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)
