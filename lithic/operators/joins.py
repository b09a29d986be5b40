"""Joins that need more than an equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, on: str) -> DataFrame:
    """Each left row with the last right row of the same ``by`` at or before its ``on``.

    ``right`` holds ``by``, ``on`` and values; left rows without a match have
    nulls. Both sides are laid together and read once in order, so the plan is
    one shuffle by ``by`` and a running value, no join of ranges.
    """
    values = [c for c in right.columns if c not in (by, on)]
    a = left.select(F.col(by).alias("_by"), F.col(on).alias("_on"), F.lit(1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"))
    b = right.select(F.col(by).alias("_by"), F.col(on).alias("_on"), F.lit(0).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in values]).alias("_last"))
    rows = a.unionByName(b, allowMissingColumns=True)
    before = Window.partitionBy("_by").orderBy("_on", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("_last", F.last("_last", ignorenulls=True).over(before)).where("_side = 1")
    return seen.select("_row.*", *[F.col("_last")[c].alias(c) for c in values])
