"""Delta compression of chunks against a base.

A delta is the length of its target (4 bytes), then operations: ``C`` with
offset and length copies from the base, ``I`` with a length and bytes
inserts. Numbers are 4 bytes, big-endian; any bytes are allowed anywhere.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 16
#: What a stored delta adds for its base's fingerprint.
OVERHEAD = 32


def create(base: bytes, target: bytes) -> bytes:
    """The delta that makes ``target`` out of ``base``."""
    index: dict[bytes, int] = {}
    for at in range(0, len(base) - BLOCK + 1, BLOCK):
        index.setdefault(base[at : at + BLOCK], at)
    out, at, literal = [struct.pack(">I", len(target))], 0, 0

    def flush(end: int) -> None:
        if end > literal:
            out.append(b"I" + struct.pack(">I", end - literal) + target[literal:end])

    while at + BLOCK <= len(target):
        from_ = index.get(target[at : at + BLOCK])
        if from_ is None:
            at += 1
            continue
        n, back = BLOCK, 0
        while at + n < len(target) and from_ + n < len(base) and target[at + n] == base[from_ + n]:
            n += 1
        while at - back > literal and from_ - back > 0 and target[at - back - 1] == base[from_ - back - 1]:
            back += 1
        flush(at - back)
        out.append(b"C" + struct.pack(">II", from_ - back, n + back))
        at += n
        literal = at
    flush(len(target))
    return b"".join(out)


def operations(delta: bytes):
    at = 4
    while at < len(delta):
        if delta[at : at + 1] == b"C":
            yield "C", *struct.unpack_from(">II", delta, at + 1)
            at += 9
        else:
            (n,) = struct.unpack_from(">I", delta, at + 1)
            yield "I", at + 5, n
            at += 5 + n


def apply(base: bytes, delta: bytes) -> bytes:
    out = b"".join(base[a : a + n] if op == "C" else delta[a : a + n] for op, a, n in operations(delta))
    if len(out) != output_size(delta):
        raise ValueError("the delta does not fit this base")
    return out


def output_size(delta: bytes) -> int:
    return struct.unpack_from(">I", delta)[0]


def analyze(delta: bytes) -> tuple[int, int]:
    """Bytes copied and bytes inserted."""
    parts = list(operations(delta))
    return sum(n for op, _, n in parts if op == "C"), sum(n for op, _, n in parts if op == "I")


def create_udf(base: Column, target: Column) -> Column:
    @F.pandas_udf("binary")
    def udf(base: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else create(a, b) for a, b in zip(base, target)])

    return udf(base, target)


def apply_udf(base: Column, delta: Column) -> Column:
    @F.pandas_udf("binary")
    def udf(base: pd.Series, delta: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else apply(a, b) for a, b in zip(base, delta)])

    return udf(base, delta)


def analyze_udf(delta: Column) -> Column:
    @F.pandas_udf("struct<n_copy:long,n_insert:long>")
    def udf(delta: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([analyze(d) for d in delta], columns=["n_copy", "n_insert"])

    return udf(delta)


def size_column(delta: Column) -> Column:
    """The target's length, from the header alone."""
    return F.conv(F.hex(F.substring(delta, 1, 4)), 16, 10).cast("long")


def encode_pairs(pairs: DataFrame, payloads: DataFrame, limit: int = 16384, tail: int = 0) -> DataFrame:
    """``(base_fp, new_fp, new_len, delta, delta_len, accepted)`` for ``pairs(base_fp, new_fp)``.

    Pairs of one fingerprint are left out, and so are pairs that are equal but
    for their last ``tail`` bytes. A delta is accepted if it and the base's
    fingerprint take less room than the chunk and than ``limit``.
    """
    data = payloads.select("fp", "data").dropDuplicates(["fp"])
    a, b = (data.select(F.col("fp").alias(f"{n}_fp"), F.col("data").alias(f"{n}_data")) for n in ("base", "new"))
    rows = pairs.select("base_fp", "new_fp").where("base_fp <> new_fp").distinct().join(a, "base_fp").join(b, "new_fp")
    if tail:
        front = lambda c: F.substring(c, F.lit(1), F.octet_length(c) - tail)
        rows = rows.where(front("base_data") != front("new_data"))
    rows = rows.withColumn("delta", create_udf("base_data", "new_data")).withColumn("delta_len", F.octet_length("delta")).withColumn("new_len", F.octet_length("new_data"))
    size = F.col("delta_len") + OVERHEAD
    return rows.select("base_fp", "new_fp", "new_len", "delta", "delta_len", ((size < F.col("new_len")) & (size < limit)).alias("accepted"))


def report(deltas: DataFrame) -> DataFrame:
    """Totals before and after, of all pairs and of the accepted ones."""
    ok = lambda c: F.coalesce(F.sum(F.when(F.col("accepted"), c)), F.lit(0)).cast("long")
    size = F.col("delta_len") + OVERHEAD
    return deltas.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("new_len"), F.lit(0)).cast("long").alias("total_bytes"), F.coalesce(F.sum(F.when(F.col("accepted"), size).otherwise(F.col("new_len"))), F.lit(0)).cast("long").alias("stored_bytes"), F.sum(F.col("accepted").cast("long")).alias("accepted_pairs"), ok(F.col("new_len")).alias("accepted_bytes"), ok(size).alias("accepted_delta_bytes"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """Each member with its group's base; bases stand whole, so chains have depth 1."""
    members = groups.where("member_fp <> base_fp")
    bases = groups.select(F.col("base_fp").alias("new_fp")).distinct()
    pairs = members.groupBy(F.col("member_fp").alias("new_fp")).agg(F.min("base_fp").alias("base_fp"))
    return pairs.join(bases, "new_fp", "left_anti").select("base_fp", "new_fp")
