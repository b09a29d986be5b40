"""Checkpoints: where lineage is cut so that nothing is computed twice."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark) -> None:
    """Let Python workers import this package, and give checkpoints the shared folder
    that ``spark.checkpoint.dir`` names; a local session may go without."""
    sc = spark.sparkContext
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


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of what is used more than once."""
    prepare(df.sparkSession)
    return df.checkpoint()


def views(spark, sf_dir: str, names: list[str], prefix: str = "") -> None:
    """The tables as temporary views, so that any SQL can be run on them."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(prefix + name)
