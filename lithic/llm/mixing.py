"""Mixing sources to target weights by balanced (cube-method) sampling.

A source's target is spread evenly over its documents: each is taken
``target / size of the source`` times on average, between 0 and 2. The whole
part is taken outright, the rest is an inclusion probability. The flight phase
moves these along directions that change neither the source's number of
documents nor its number of words (the null space of both constraints), until
each reaches 0 or 1. Large documents fly first, so that what stays open is
small. It runs in blocks of at most ``BLOCK`` documents of one source, dealt by
a hash; a block leaves two open probabilities at most, and what is open flies
again, round by round, until a source is one block. The landing phase draws
the last two open documents so that each keeps its probability, in the one of
the two ways whose words are expected nearer to the target.

Every step keeps every inclusion probability on average. Random numbers come
from hashes of the block, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, prepare, read, whole

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
BLOCK = 256
EPS = 1e-9


def words(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(stats: DataFrame) -> DataFrame:
    """``stats(source, source_size)`` with ``target``.

    Weights go by the sources' order, which is numbered through the partitions
    of a global sort; the driver sees the rows of each partition and two sums.
    """
    ordered = cut(stats.orderBy(F.asc_nulls_last("source")))
    at = F.monotonically_increasing_id()
    ordered = ordered.select("*", F.shiftright(at, 33).cast("int").alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    counts = sorted((r["_part"], r["n"]) for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for part, n in counts:
        starts.append((part, before))
        before += n
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in starts for x in pair]), F.col("_part")) if starts else F.lit(0)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(offset + F.col("_row"), F.lit(len(WEIGHTS))).cast("int") + 1)
    ordered = ordered.withColumn("_w", weight)
    cap = MOST * F.col("source_size")
    total = ordered.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    unit, full = 0.0, -1
    while True:
        above = cap < F.col("_w") * unit if full >= 0 else F.lit(False)
        r = ordered.agg(F.count(F.when(above, 1)).alias("n"), F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)).alias("c"), F.coalesce(F.sum(F.when(~above, F.col("_w"))), F.lit(0.0)).alias("w")).first()
        if r["n"] == full or not r["w"]:
            break
        full, unit = r["n"], (SHARE * total - r["c"]) / r["w"]
    return ordered.withColumn("target", F.least(cap.cast("double"), F.col("_w") * unit)).drop("_part", "_row", "_w")


def flight(pi: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Move ``pi``, large documents first, until two are open at most; sums of pi and pi * size stay."""
    p, s = pi.tolist(), [float(x) for x in size]
    rng = np.random.default_rng(seed)
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    mixed = rng.permutation(len(p))
    waiting = iter(mixed[np.argsort(-size[mixed], kind="stable")].tolist())
    active: list[int] = []
    while True:
        active = [i for i in active if EPS < p[i] < 1 - EPS]
        for i in waiting:
            if EPS < p[i] < 1 - EPS:
                active.append(i)
            if len(active) == 3:
                break
        if len(active) < 3:
            return np.array([0.0 if x <= EPS else 1.0 if x >= 1 - EPS else x for x in p])
        a, b, c = (s[i] for i in active)
        v = (c - b, a - c, b - a)
        if v == (0.0, 0.0, 0.0):
            v = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / d if d > 0 else -p[i] / d for i, d in zip(active, v) if d)
        down = min(p[i] / d if d > 0 else (p[i] - 1) / d for i, d in zip(active, v) if d)
        step = up if next(draws, 0.5) * (up + down) < down else -down
        for i, d in zip(active, v):
            x = p[i] + step * d
            p[i] = 0.0 if x <= EPS else 1.0 if x >= 1 - EPS else x


def landing(pi: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Close the two open ones (or one) by a draw that keeps their probabilities.

    Both are taken with a chance t, which may lie between two ends; the words
    expected off the target are linear in t, so the better end is best.
    """
    at = np.flatnonzero((pi > 0) & (pi < 1))
    out, u = pi.copy(), np.random.default_rng(seed + 1).random()
    if len(at) == 1:
        out[at] = float(u < pi[at[0]])
    elif len(at):
        (p, q), (a, b) = pi[at], size[at].astype(float)
        chances = [(t, p - t, q - t, 1 - p - q + t) for t in (max(0.0, p + q - 1), min(p, q))]
        off = [abs((x - p) * a + (y - q) * b) for x, y in ((1, 1), (1, 0), (0, 1), (0, 0))]
        best = min(chances, key=lambda c: round(sum(x * y for x, y in zip(c, off)), 6))
        out[at] = ((1, 1), (1, 0), (0, 1), (0, 0))[min(3, int(np.searchsorted(np.cumsum(best), u, "right")))]
    return out


UNIT = "id {id}, source {source}, size long, more long, n long, k long, pi double, blocks int, block int"


def _fly(units: DataFrame, schema: str) -> DataFrame:
    def fly(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "more"], kind="stable").reset_index(drop=True)
        size, pi = pdf["size"].to_numpy(), pdf["pi"].to_numpy().copy()
        seed = int(np.bitwise_xor.reduce(pdf["more"].to_numpy(np.int64).view(np.uint64))) ^ len(pdf)
        pi = flight(pi, size, seed)
        return pdf.assign(pi=landing(pi, size, seed) if pdf["blocks"].iloc[0] == 1 else pi)

    return units.groupBy("source", "block").applyInPandas(fly, schema)


def takes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """How often the mix takes each document.

    Returns ``id, source, size, more, n, source_size, target, whole, extra``: n rows
    share the id, source, size and ``more`` (a hash of these); each is taken ``whole``
    times, ``extra`` of them once more. Null sources are a source, the last;
    null ids are ids; null and empty texts have no words; an empty table gives
    no rows, and sources without words a target of 0.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), (words() if size is None else size).alias("size"))
    units = cut(rows.withColumn("more", F.xxhash64("id", "source", "size")).groupBy("id", "source", "size", "more").agg(F.count("*").alias("n")))
    stats = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    stats = targets(stats)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    stats = stats.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio").cast("int"))
    here = stats.withColumnRenamed("source", "_source")
    units = units.join(here, units.source.eqNullSafe(here["_source"])).drop("_source")
    part = F.col("n") * (F.col("ratio") - F.col("whole"))
    units = units.withColumn("k", F.floor(part + EPS)).withColumn("pi", F.greatest(F.lit(0.0), part - F.col("k")))
    units = units.withColumn("pi", F.when(F.col("pi") <= EPS, 0.0).otherwise(F.col("pi")))
    units = units.withColumn("blocks", F.ceil(F.col("units") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("more"), F.col("blocks")).cast("int"))
    kinds = {f.name: f.dataType.simpleString() for f in units.schema.fields}
    schema = UNIT.format(id=kinds["id"], source=kinds["source"])
    names = [x.split()[0] for x in schema.split(", ")]
    units = units.select(names)
    shut = units.where("pi = 0")
    open_ = cut(_fly(units.where("pi > 0"), schema))
    done = [shut, open_.where("pi = 0 or pi = 1")]
    while True:
        open_ = open_.where("pi > 0 and pi < 1")
        if open_.isEmpty():
            break
        left = open_.groupBy("source").agg(F.count("*").alias("left")).withColumnRenamed("source", "_source")
        open_ = open_.join(left, open_.source.eqNullSafe(left["_source"]))
        open_ = open_.withColumn("blocks", F.ceil(F.col("left") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("more", "blocks"), F.col("blocks")).cast("int"))
        open_ = cut(_fly(open_.select(names), schema))
        done.append(open_.where("pi = 0 or pi = 1"))
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    out = out.select("id", "source", "size", "more", "n", (F.col("k") + F.col("pi").cast("long")).alias("extra"))
    return out.join(here.select("_source", "source_size", "target", "whole"), out.source.eqNullSafe(here["_source"])).drop("_source")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; same columns.

    Rows that share id, source and size are told apart by a row number, only
    where several do.
    """
    size = words(text_col)
    got = takes(docs, id_col, source_col, size).select("more", F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("n").alias("_n"), F.col("whole").alias("_whole"), F.col("extra").alias("_extra"))
    rows = docs.select(whole(docs), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")).withColumn("_more", F.xxhash64("id", "source", "size"))
    same = (F.col("_more") == F.col("more")) & F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    rows = rows.join(got, same).select("row", "_more", "id", "source", "size", "_n", "_whole", "_extra")
    one = rows.where("_n = 1").withColumn("_copies", F.col("_whole") + F.col("_extra"))
    several = rows.where("_n > 1").withColumn("_i", F.row_number().over(Window.partitionBy("_more", "id", "source", "size").orderBy(F.to_json("row"))))
    several = several.withColumn("_copies", F.col("_whole") + (F.col("_i") <= F.col("_extra")).cast("long")).drop("_i")
    every = one.unionByName(several).withColumn("_copies", F.col("_copies").cast("int")).where("_copies > 0")
    return every.select("row", F.explode(F.sequence(F.lit(1), "_copies"))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    each = takes(docs).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    taken = F.col("size") * (F.col("whole") + (F.col("i") <= F.col("extra")).cast("long"))
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))
