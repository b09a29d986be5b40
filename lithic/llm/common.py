"""What the operators of this subpackage share: shipping, checkpoints, stars."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

#: What separates words wherever a contract says ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and give checkpoints a folder.

    The folder is the one that ``spark.checkpoint.dir`` names; only a local
    session that names none gets a temporary one. Batches that go to Python
    are bounded in bytes, unless the session bounds them already, as texts
    may be long.
    """
    sc = spark.sparkContext
    if int("".join(filter(str.isdigit, spark.conf.get(BATCH_BYTES)))) > BATCH:
        spark.conf.set(BATCH_BYTES, str(BATCH))
    have = sc.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (have, ROOT) if x)
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lithic-")
        sc.setCheckpointDir(folder)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(df: DataFrame, *without: str) -> Column:
    """A row as one struct, so that no name of its columns meets one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in without]).alias("row")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, kept where every executor sees it."""
    return df.checkpoint(eager=True)


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object] | None = None) -> object:
    """This Python worker's one large object, kept from task to task.

    Workers are used again by the operators that follow, so whoever asks for
    another one, or for none, lets go of what is held.
    """
    if name not in _held:
        _held.clear()
        if make:
            _held[name] = make()
    return _held.get(name)


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` computed once, and marked for broadcast only if it has ``most`` rows or fewer."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges(u, v)`` are undirected links of longs. Returns ``(v, root)``, root
    being the smallest id of v's component, for every vertex that is not
    itself the root. Each round is two partial aggregations and two joins on
    the vertex, which adaptive execution may split where a vertex is hot; no
    component is gathered anywhere. An empty table gives an empty table.
    """
    links = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct())
    while True:
        both = links.unionAll(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        after = cut(small.where("u <> v").distinct())
        # A star forest: nobody is a child of two, and no root is itself a child.
        loose = after.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
        if loose.isEmpty() and after.join(after.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            return after.select("v", F.col("u").alias("root"))
        links = after
