"""Secret scans over an incremental ledger of blobs.

A text is a version of a blob, addressed by its content (SHA-256). The ledger
is a table of Parquet files in a folder that all executors share, one row for
each (blob, rule version) that was ever scanned, findings or not. A scan takes
the blobs whose pair the ledger lacks, each once however many rows share it,
scans only these, appends them, and joins the findings back to every row that
holds the blob: every path and every version of it. Rows are only ever
appended; a pair that two scans appended at once counts once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read, whole

RULES = "rules-1"
#: Kinds in the order that decides ties of start.
KINDS = ("assign", "access", "hex", "pem", "jwt")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")  # whole runs, as HEX finds them, of 24 and more
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
HINT = re.compile(r"(?ai:passw|secret|token|key)")


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every finding, in order; code points."""
    out = []
    if HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    if "-----BEGIN" in text:
        out += [(m.start(), 3, m.end()) for m in PEM.finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), 4, m.end()) for m in JWT.finditer(text)]
    return sorted(out)


def as_string(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def blob(text_col: str) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


LEDGER = "blob binary, rules string, n_assign long, n_access long, n_hex long, base_spans string, spans string"


def ledger_at(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger in ``folder``, which is made if there is none."""
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: str = RULES) -> DataFrame:
    """Ledger rows of the blobs in ``docs`` that ``ledger`` lacks under ``rules``.

    A null text is the empty blob; a text of any length is one blob, scanned
    whole; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    blobs = docs.select(blob(text_col).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    blobs = blobs.dropDuplicates(["blob"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for b, text in zip(pdf["blob"], pdf["text"]):
                found = spans(text)
                n = [sum(k == i for _, k, _ in found) for i in range(3)] if found else (0, 0, 0)
                rows.append((b, rules, *n, as_string([x for x in found if x[1] < 3]), as_string(found)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in LEDGER.split(", ")])

    return blobs.mapInPandas(run, LEDGER)


def scan(docs: DataFrame, folder: str | None = None, text_col: str = "text", rules: str = RULES) -> DataFrame:
    """Bring the ledger in ``folder`` up to ``docs``, then see ``findings``.

    Without a folder the ledger is that of ``spark.lithic.ledger.dir``, or a
    new one under ``spark.checkpoint.dir`` if that is not set either.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or spark.conf.get("spark.lithic.ledger.dir", None) or f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}"
    before = ledger_at(spark, folder)
    scan_unseen(docs, before, text_col, rules).write.mode("append").parquet(folder)
    return findings(docs, spark.read.schema(LEDGER).parquet(folder), text_col, rules)


def findings(docs: DataFrame, ledger: DataFrame, text_col: str = "text", rules: str = RULES) -> DataFrame:
    """Every row of ``docs`` (without its text) with the ledger's findings.

    Adds ``n_assign, n_access, n_hex, base_spans, spans``; columns of these
    names are replaced. Only blobs with findings are joined, so the hot side
    of a blob that many rows share is narrow. Repeated rows stay, each with
    its findings; an empty table stays empty.
    """
    new = ("n_assign", "n_access", "n_hex", "base_spans", "spans")
    rows = docs.select(whole(docs, text_col, *new), blob(text_col).alias("blob"))
    hits = ledger.where((F.col("rules") == rules) & (F.col("spans") != "")).dropDuplicates(["blob"]).select("blob", *new)
    zero = {c: F.lit(0).cast("long") for c in new[:3]} | {c: F.lit("") for c in new[3:]}
    return rows.join(hits, "blob", "left").select("row.*", *[F.coalesce(c, z).alias(c) for c, z in zero.items()])


def exposure(found: DataFrame, path_col: str, version_col: str) -> DataFrame:
    """What ``findings`` of all versions say of each path.

    ``path, n_versions, n_exposed, first_exposed, last_exposed, live``: the
    versions with findings, and whether the newest one has any. Rows without
    a path are one path; versions that are null count, but are never first,
    last or newest.
    """
    hit = F.col("spans") != ""
    out = found.groupBy(F.col(path_col).alias("path")).agg(
        F.count("*").alias("n_versions"),
        F.count(F.when(hit, 1)).alias("n_exposed"),
        F.min(F.when(hit, F.col(version_col))).alias("first_exposed"),
        F.max(F.when(hit, F.col(version_col))).alias("last_exposed"),
        F.max(version_col).alias("newest"),
    )
    return out.select("path", "n_versions", "n_exposed", "first_exposed", "last_exposed", F.coalesce(F.col("last_exposed") == F.col("newest"), F.lit(False)).alias("live"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
