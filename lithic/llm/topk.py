"""Exact top-k by inner product: a ball tree per shard, branch and bound.

Every shard becomes a ball tree. A node bounds the inner product of a query q
with its rows by ``q . centre + |q| * radius``. Nodes are opened in the order
of that bound, and none whose bound lies below the query's current kth score;
``grid`` builds each tree once, carries this score from shard to shard and
shares the best kth scores of the first shards with all others.

Components become ``floor(1024 * x)``. Sums are exact: in doubles where they
stay below 2**53, else in Python's integers, then held within a long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read
from .grid import merge, search, usable

SCALE = 1024.0
LEAF = 64


def ball_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The leaves' row numbers, and per level (centres, radii, parents)."""
    groups, parents, levels = [np.arange(len(x))], np.zeros(1, int), []
    while True:
        centres = np.array([x[g].mean(0) for g in groups])
        radii = np.array([np.sqrt(((x[g] - c) ** 2).sum(1).max()) for g, c in zip(groups, centres)])
        levels.append((centres, radii, parents))
        if all(len(g) <= leaf for g in groups):
            return groups, levels
        split, parents = [], []
        for no, g in enumerate(groups):
            halves = [g]
            if len(g) > leaf:
                far = x[g[((x[g] - centres[no]) ** 2).sum(1).argmax()]]
                other = x[g[((x[g] - far) ** 2).sum(1).argmax()]]
                order = g[np.argsort(x[g] @ (other - far), kind="stable")]
                halves = [order[: len(g) // 2], order[len(g) // 2 :]]
            split += halves
            parents += [no] * len(halves)
        groups, parents = split, np.array(parents)


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as doubles within a long."""
    if q.size == 0 or x.size == 0 or np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**53:
        return q @ x.T
    a, b = (np.array([[int(v) for v in row] for row in m], dtype=object) for m in (q, x))
    top = 2**63 - 1024
    return np.clip((a @ b.T), -top, top).astype(np.float64)


def branch_and_bound(q_rids, q, floor, best, scores, rids, ids, x, tree):
    """One shard's finder, see ``grid.search``."""
    leaves, levels = tree
    norm = np.sqrt((q**2).sum(1))
    slack = 1e-6 + 1e-9 * norm * np.sqrt((x**2).sum(1)).max(initial=0)
    kth = np.maximum(floor, scores[:, -1])
    live, bound = np.ones((len(q), 1), bool), None
    for centres, radii, parents in levels:
        bound = q @ centres.T + norm[:, None] * radii + slack[:, None]
        live = live[:, parents] & (bound >= kth[:, None])
    for leaf in np.argsort(-np.where(live, bound, -np.inf).max(0), kind="stable"):
        at = np.flatnonzero(live[:, leaf] & (bound[:, leaf] >= kth))
        if len(at):
            rows = leaves[leaf]
            new = inner(q[at], x[rows])
            new[(rids[rows] == q_rids[at, None]) | (new < kth[at, None])] = -np.inf
            some = (new > -np.inf).any(1)
            at, new = at[some], new[some]
            best[at], scores[at] = merge(best[at], scores[at], np.broadcast_to(ids[rows], new.shape), new)
            kth[at] = np.maximum(kth[at], scores[at, -1])
    return best, scores


def exact_top_k(vectors: DataFrame, asks: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest integer inner products of each row for which ``asks`` holds.

    A query's own row is no candidate; ties go to the smaller id; fewer than k
    candidates give them all; empty tables give no rows; other columns, of any
    name, take no part. Nulls, repeated ids and lengths: see ``grid``.
    """
    prepare(vectors.sparkSession)
    rows = usable(vectors, asks, id_col, vec_col).withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")))
    return search(rows, k, ball_tree, branch_and_bound, "long")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, 10)


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.rid <> q.rid AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p)
WHERE rank <= 10
"""
