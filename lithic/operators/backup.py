"""The persistent store: versions go in, differences and files come out.

Everything lies in one folder that all executors share, as Parquet tables that
only grow:

* ``heads``: a row for each file version, with its totals;
* ``recipes``: each version's chunks in order (index and recipe);
* ``payload``: each chunk's bytes once, in batches;
* ``counts``: how often each fingerprint was added, by batch; their sum is the
  store's reference count;
* ``deltas``: payloads encoded against a base;
* ``features``: the super-features of each chunk, once.

A batch is appended in the order payload, counts, recipes, heads, under a name
of its own. It counts once its heads are there: what a broken run left has no
heads and is never read, but for payloads, which any run may use.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import Options
from ..plans.session import cut
from ..sources.files import next_version
from . import delta, diff, similarity, store
from .chunking import chunks
from .dedup import collect_garbage, file_totals, probe, ref_counts

SCHEMAS = {
    "heads": "file_id {id}, version int, file_size long, total_chunks long, batch string",
    "recipes": "file_id {id}, version int, chunk_id int, byte_off long, chunk_len int, fp string, batch string",
    "payload": "fp string, data binary",
    "counts": "fp string, chunk_len int, ref_count long, batch string",
    "features": "fp string, sf array<string>",
    "deltas": "base_fp string, new_fp string, new_len int, delta binary, delta_len int, accepted boolean",
}


class Store:
    """A store in ``folder``; ``id_type`` is the type of ``file_id``."""

    def __init__(self, spark: SparkSession, folder: str, options: Options, id_type: str = "string"):
        self.spark, self.folder, self.options = spark, folder.rstrip("/"), options
        self.schemas = {k: v.format(id=id_type) for k, v in SCHEMAS.items()}
        for name, schema in self.schemas.items():
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.folder}/{name}")

    def table(self, name: str) -> DataFrame:
        """A table's rows; of recipes and counts those of batches that are whole."""
        rows = self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}")
        return rows.join(self.table("heads").select("batch").distinct(), "batch", "left_semi") if name in ("recipes", "counts") else rows

    def append(self, name: str, df: DataFrame) -> None:
        columns = [x.split()[0] for x in self.schemas[name].split(", ")]
        df.select(columns).write.mode("append").parquet(f"{self.folder}/{name}")

    def versions(self) -> DataFrame:
        """``(file_id, next_version, previous_version)`` of every file that is there."""
        return next_version(self.table("heads"))

    def counts(self) -> DataFrame:
        """``(fp, chunk_len, ref_count)``: the store's entries."""
        return self.table("counts").groupBy("fp").agg(F.max("chunk_len").alias("chunk_len"), F.sum("ref_count").alias("ref_count"))

    def probe(self, chunks_: DataFrame, known: bool = True) -> DataFrame:
        """Chunks whose fingerprint the store holds, or lacks."""
        return probe(chunks_, self.table("counts"), known)

    def ingest(self, files: DataFrame) -> DataFrame:
        """Add ``files(file_id, content)``, each as its next version.

        Returns ``(file_id, version, file_size, total_chunks, new_chunks,
        new_bytes)``: a chunk is new to the first file that brings it.
        """
        last = self.versions().select("file_id", "next_version")
        files = files.select("file_id", "content").join(last, "file_id", "left")
        files = files.select("file_id", F.coalesce("next_version", F.lit(0)).alias("version"), "content")
        found = cut(chunks(files, self.options))
        fresh = self.probe(found, known=False)
        order = F.struct("version", "file_id", "chunk_id")
        first = cut(fresh.groupBy("fp").agg(F.min(order).alias("at"), F.max("chunk_len").alias("chunk_len")))
        self.append("payload", store.payload_store(fresh))
        batch = F.lit(uuid.uuid4().hex).alias("batch")
        heads = cut(file_totals(found))
        self.append("counts", ref_counts(found).select("*", batch))
        self.append("recipes", found.select("*", batch))
        self.append("heads", heads.select("*", batch))
        new = first.groupBy(F.col("at.file_id").alias("file_id"), F.col("at.version").alias("version")).agg(F.count("*").alias("new_chunks"), F.sum("chunk_len").alias("new_bytes"))
        none = F.lit(0).cast("long")
        return heads.join(new, ["file_id", "version"], "left").select("file_id", "version", "file_size", "total_chunks", F.coalesce("new_chunks", none).alias("new_chunks"), F.coalesce("new_bytes", none).alias("new_bytes"))

    def version(self, back: int = 0) -> DataFrame:
        """Every file's recipe, ``back`` versions before its last."""
        want = self.table("heads").groupBy("file_id").agg((F.max("version") - back).alias("version"))
        return self.table("recipes").join(want, ["file_id", "version"], "left_semi")

    def changes(self, mode: str = "anchor") -> DataFrame:
        """The regions in which each file's last version differs from the one before."""
        return diff.detect(self.version(1), self.version(0), mode, self.options.diff_window)

    def save_deltas(self) -> DataFrame:
        """Encode the edges of changed regions against the version before; returns the report."""
        old, new = self.version(1), self.version(0)
        known = old.select("fp").distinct()
        marked = new.join(known.withColumn("_old", F.lit(True)), "fp", "left").withColumn("is_unique", F.col("_old").isNull()).drop("_old")
        pairs = diff.positional_pairs(diff.anchor_regions(old, new), old, marked)
        made = cut(delta.encode_pairs(pairs, self.table("payload"), tail=2))
        self.append("deltas", made)
        return delta.report(made)

    def save_features(self) -> DataFrame:
        """Sketch the chunks that have no features yet; returns the similarity groups of all."""
        n = self.options.super_features
        fresh = self.table("payload").join(self.table("features").select("fp"), "fp", "left_anti")
        self.append("features", similarity.sketches(fresh, n, prefix=self.options.feature_prefix))
        return similarity.groups(self.table("features").dropDuplicates(["fp"]), n)

    def save_similar(self, groups: DataFrame) -> DataFrame:
        """Encode the members of similarity groups against their bases; returns the report."""
        made = cut(delta.encode_pairs(delta.group_pairs(groups), self.table("payload")))
        self.append("deltas", made)
        return delta.report(made)

    def containers(self) -> DataFrame:
        """``(fp, lane, container_id, offset, chunk_len)``: where each payload lies."""
        return store.pack_exact(self.counts(), self.options.container_cap)

    def delta_containers(self) -> DataFrame:
        """The same of accepted deltas, each with its base's fingerprint before it."""
        ok = self.table("deltas").where("accepted")
        return store.pack_exact(ok.select(F.col("new_fp").alias("fp"), (F.col("delta_len") + delta.OVERHEAD).alias("chunk_len")), self.options.delta_container_cap)

    def compacted(self, gone: DataFrame) -> DataFrame:
        """``containers`` once the versions in ``gone(file_id, version)`` are deleted."""
        left = self.table("recipes").join(gone, ["file_id", "version"], "left_anti")
        packed = cut(self.containers())
        return store.compact(packed, collect_garbage(self.counts(), left), self.options.compact_below, self.options.container_cap)

    def restore(self, back: int = 0, deltas: bool = False) -> DataFrame:
        """``(file_id, version, content, complete)``, by way of the deltas if asked for."""
        payload = self.table("payload").dropDuplicates(["fp"])
        return store.restore(self.version(back), store.apply_deltas(payload, self.table("deltas")) if deltas else payload)

    def restore_parts(self, back: int = 0, part: int = 64 << 20) -> DataFrame:
        """Files of any size, in parts."""
        return store.restore_parts(self.version(back), self.table("payload").dropDuplicates(["fp"]), part)

    def raw(self, back: int = 0) -> DataFrame:
        """The stored bytes of each chunk as they are, deltas not decoded."""
        return store.raw(self.version(back), store.apply_deltas(self.table("payload").dropDuplicates(["fp"]), self.table("deltas")))
