"""A database of collections: Parquet folders that all executors share.

A collection is a folder of versions. A write makes the next version whole and
then takes the old ones away, so that a reader never meets half a write and a
write may read what it replaces. ``stages.run`` writes through it: ``$out``
and ``$merge`` end in files.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.collection import validated


class Collections(MutableMapping):
    """``db[name]`` reads, ``db[name] = df`` replaces, ``del db[name]`` drops."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.rules: dict[str, dict] = {}
        path = self._path(self.folder)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _versions(self, name: str) -> list[int]:
        """Whole versions: those whose write has ended."""
        path = self._path(f"{self.folder}/{name}")
        found = self.fs.listStatus(path) if self.fs.exists(path) else []
        numbers = [int(x.getPath().getName()) for x in found]
        return sorted(n for n in numbers if self.fs.exists(self._path(f"{self.folder}/{name}/{n}/_SUCCESS")))

    def __getitem__(self, name: str) -> DataFrame:
        found = self._versions(name)
        if not found:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}/{found[-1]}")

    def __setitem__(self, name: str, df: DataFrame) -> None:
        found = self._versions(name)
        rule = self.rules.get(name)
        df = validated(df, rule) if rule else df
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/{found[-1] + 1 if found else 0}")
        for old in found:
            self.fs.delete(self._path(f"{self.folder}/{name}/{old}"), True)

    def __delitem__(self, name: str) -> None:
        if name not in self:
            raise KeyError(name)
        self.fs.delete(self._path(f"{self.folder}/{name}"), True)

    def __contains__(self, name: object) -> bool:
        return bool(self._versions(str(name)))

    def __iter__(self) -> Iterator[str]:
        names = sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(self.folder)))
        return (n for n in names if n in self)

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def create(self, name: str, df: DataFrame, rule: dict | None = None) -> None:
        """A new collection; every later write must keep ``rule``."""
        if name in self:
            raise ValueError(f"{name} exists")
        if rule:
            self.rules[name] = rule
        self[name] = df

    def rename(self, old: str, new: str) -> None:
        if old not in self or new in self:
            raise ValueError(f"{old} must exist, {new} must not")
        self.fs.rename(self._path(f"{self.folder}/{old}"), self._path(f"{self.folder}/{new}"))
        if old in self.rules:
            self.rules[new] = self.rules.pop(old)

    def views(self) -> list[str]:
        """Every collection as a temporary view for SQL."""
        for name in self:
            self[name].createOrReplaceTempView(name)
        return list(self)
