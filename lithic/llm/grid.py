"""Query blocks against shards of rows: what the two vector searches share.

Rows are dealt by a hash of their number to shards of about ``SHARD_ROWS``.
Each shard is packed once, with its index, into one row of a checkpointed
table, and never moves again. Queries go to the shards instead, in blocks of
about ``BLOCK_ROWS``, each broadcast; their number is what a block bounds, not
the input. For a block

* some shards are searched first (the root of their number). The kth scores
  found there, one for each query of the block, are shared with all others;
* every other shard is searched from these scores on. A task carries what it
  found from shard to shard and hands on only what reaches the shared score,
  so that few rows are shuffled for the final ranks.

Vectors null, or holding null or non-finite components, take no part. A row is
known by a number, not by its id: rows that repeat an id, or have none, are
rows like any other; a query is no candidate of its own. Vectors of another
length than the query's are not its candidates. Ties go to the smaller id,
none after all others.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARD_ROWS = 4096
BLOCK_ROWS = 8192
#: Stands for a missing id, after all others.
NO_ID = np.iinfo(np.int64).max


def usable(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(rid long, vec_id long, v array<double>, asks boolean)`` of the rows that take part, checkpointed."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")).where("v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    return cut(rows.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "v", "asks"))


def sharded(rows: DataFrame, build: Callable[[np.ndarray], object]) -> tuple[DataFrame, int]:
    """One row for each shard and vector length, with the index that ``build`` makes; and the number of shards."""
    n = -(-rows.count() // SHARD_ROWS) or 1

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, part in pdf.groupby(pdf["v"].map(len)):
            vecs = np.array(list(part["v"]), np.float64)
            out.append((key[0], dim, part["rid"].to_numpy(np.int64).tobytes(), part["vec_id"].to_numpy(np.int64).tobytes(), vecs.tobytes(), pickle.dumps(build(vecs))))
        return pd.DataFrame(out, columns=["shard", "dim", "rids", "ids", "vecs", "index"])

    dealt = rows.select("rid", "vec_id", "v", F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int").alias("shard")).repartition(n, "shard")
    return cut(dealt.groupBy("shard").applyInPandas(pack, "shard int, dim int, rids binary, ids binary, vecs binary, index binary")), n


def search(rows: DataFrame, k: int, build: Callable, finder: Callable, score_type: str) -> DataFrame:
    """Each query's k best rows: ``query_id, rank, vec_id, score``.

    ``finder(q_rids, q, floor, best, scores, rids, ids, vecs, index)`` returns
    the best ids and scores after one more shard, best first, ties to the
    smaller id; what lies below ``floor`` it may leave out.
    """
    spark = rows.sparkSession
    shards, n_shards = sharded(rows, build)
    queries = rows.where("asks").select("rid", "vec_id", "v")
    n_blocks = -(-queries.count() // BLOCK_ROWS)
    queries = queries.withColumn("block", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(max(1, n_blocks))))
    first = int(np.ceil(np.sqrt(n_shards)))
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id"))
    found = []

    def run(shards: DataFrame, block: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = [(np.full((len(r), k), NO_ID), np.full((len(r), k), -np.inf)) for r, _, _, _ in shared.value]
            for pdf in batches:
                for s in pdf.itertuples():
                    rids, ids = np.frombuffer(s.rids, np.int64), np.frombuffer(s.ids, np.int64)
                    vecs, index = np.frombuffer(s.vecs, np.float64).reshape(len(ids), s.dim), pickle.loads(s.index)
                    for no, (r, _, q, floor) in enumerate(shared.value):
                        if q.shape[1] == s.dim:
                            state[no] = finder(r, q, floor, *state[no], rids, ids, vecs, index)
            for (r, q_ids, _, floor), (best, scores) in zip(shared.value, state):
                ok = (scores > -np.inf) & (scores >= floor[:, None])
                yield pd.DataFrame({"rid": np.repeat(r, k)[ok.ravel()], "query_id": np.repeat(q_ids, k)[ok.ravel()], "vec_id": best[ok], "score": scores[ok]})

        return shards.select("dim", "rids", "ids", "vecs", "index").mapInPandas(work, "rid long, query_id long, vec_id long, score double")

    for no in range(n_blocks):
        pdf = queries.where(F.col("block") == no).toPandas()  # about BLOCK_ROWS rows
        block = [(p["rid"].to_numpy(np.int64), p["vec_id"].to_numpy(np.int64), np.array(list(p["v"]), np.float64), np.full(len(p), -np.inf)) for _, p in pdf.groupby(pdf["v"].map(len))]
        part = run(shards.where(F.col("shard") < first), block)
        if n_shards > first:
            part = cut(part)
            kth = {r["rid"]: r["score"] for r in part.withColumn("rank", rank).where(F.col("rank") == k).select("rid", "score").collect()}  # one for each query of the block
            block = [(r, i, q, np.array([kth.get(x, -np.inf) for x in r.tolist()])) for r, i, q, _ in block]
            part = part.unionAll(run(shards.where(F.col("shard") >= first), block))
        found.append(cut(part.withColumn("rank", rank).where(F.col("rank") <= k)) if n_blocks > 1 else part.withColumn("rank", rank).where(F.col("rank") <= k))
    if not found:
        found = [rows.select("rid", F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")]
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return reduce(DataFrame.unionAll, found).select(real("query_id"), "rank", real("vec_id"), F.col("score").cast(score_type).alias("score"))


def merge(best: np.ndarray, scores: np.ndarray, ids: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best first, ties to the smaller id; ``ids`` and ``new`` are queries x candidates."""
    k = best.shape[1]
    all_ids, all_scores = np.concatenate([best, ids], 1), np.concatenate([scores, new], 1)
    if all_scores.shape[1] > 4 * k:  # keep what may be among the k best, ties included, before sorting
        kth = -np.partition(-all_scores, k - 1, axis=1)[:, k - 1]
        width = int((all_scores >= kth[:, None]).sum(1).max(initial=k))
        if width < all_scores.shape[1]:
            at = np.argpartition(-all_scores, min(width, all_scores.shape[1] - 1), axis=1)[:, :width]
            all_ids, all_scores = np.take_along_axis(all_ids, at, 1), np.take_along_axis(all_scores, at, 1)
    order = np.lexsort((all_ids, -all_scores), axis=-1)[:, :k]
    return np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_scores, order, 1)
