"""Removal of repeated passages: bucket-pointer refinement of byte positions.

A byte goes if a string of ``span`` bytes that covers it also starts anywhere
else, in the same text or another. As in a suffix array built by bucket-pointer
refinement, positions start in buckets of equal q-grams (``span / 4`` bytes),
and buckets are refined by the bucket identifiers of later offsets: of s and
s + q for strings of 2q bytes, and these, used again at s and s + 2q, for
strings of 4q. Identifiers are 64-bit hashes in place of ranks, so that no
global sort of all positions is needed; they only ever refine a bucket, which
is itself known by a 64-bit identifier.

To refine only what can matter, a position is filed under the least q-gram
identifier within its string: equal strings share it, and neighbouring
positions mostly share it too. A run of such neighbours is one row:

1. buckets of one place, with no gram twice in the run, are done: nothing repeats;
2. a run whose whole stretch (first to last string) is found at two places is
   done: all of it repeats. Its two outer strings identify the stretch;
3. what is left (runs across the edge of a repeated passage) is refined
   position by position, together with one representative of each stretch in
   its bucket. Buckets over ``hot`` runs are split by the string identifier,
   a row a position, so that none is gathered into one task.

Texts are read once for the runs, and shuffled once by their key; both later
reads of that shuffle are joins with narrow rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prepare, read

SPAN = 400
_BYTE = np.random.default_rng(10).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def grams(b: np.ndarray, q: int) -> np.ndarray:
    """Bucket identifiers of the q-grams at every position."""
    p, inverse = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * p[: len(b)], out=sums[1:])
    return mixed((sums[q:] - sums[:-q]) * inverse[: len(b) - q + 1])


def refined(ids: np.ndarray, by: int) -> np.ndarray:
    """Identifiers of strings ``by`` longer, from those at later offsets."""
    return mixed(ids[:-by] * np.uint64(0xD6E8FEB86659FD93) + ids[by:])


def strings(g: np.ndarray, q: int) -> np.ndarray:
    """Identifiers of the strings of 4q bytes, from the q-grams'."""
    return refined(refined(g, q), 2 * q)


def sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    m, w, n = g, 1, len(g) - width + 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[:n], m[width - w : width - w + n])


def blocks(raws: list[bytes], size: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end in blocks: (numbers, where each starts, bytes)."""
    lo, total = 0, 0
    for i, r in enumerate(raws):
        total += len(r)
        if total >= size or i + 1 == len(raws):
            part = raws[lo : i + 1]
            n = np.array([len(x) for x in part], np.int64)
            yield np.arange(lo, i + 1), np.cumsum(n) - n, np.frombuffer(b"".join(part), np.uint8)
            lo, total = i + 1, 0


def runs(starts: np.ndarray, b: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(text, first, last, bucket, stretch, twice) of every run of positions.

    ``b`` holds texts of ``span`` bytes or more, which begin at ``starts``.
    """
    q = span // 4
    most = span - q  # longer runs are cut: two strings must cover a stretch
    g = grams(b, q)
    ids, least = strings(g, q), sliding_min(g, most + 1)
    ends = np.append(starts[1:], len(b))
    begins = np.zeros(len(least) + 1, bool)
    begins[starts] = True
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]) | begins[:-1])
    text = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(least)), ends[text] - span + 1) - 1
    ok = last >= first  # strings across two texts are none
    text, first, last = text[ok], first[ok], last[ok]
    pieces = (last - first) // most + 1
    if pieces.max() > 1:
        at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        text, end = np.repeat(text, pieces), np.repeat(last, pieces)
        first = np.repeat(first, pieces) + at * most
        last = np.minimum(first + most - 1, end)
    h = least[first]
    stretch = mixed(mixed(ids[first] + (last - first).astype(np.uint64)) ^ ids[last])
    # Whether a run's least gram stands in it twice: look up where grams are some run's.
    known, low = np.unique(h), np.uint64(0xFFFF)
    some = np.zeros(1 << 16, bool)
    some[known & low] = True
    at = np.flatnonzero(some[g & low])
    which = np.minimum(np.searchsorted(known, g[at]), len(known) - 1)
    at, which = at[known[which] == g[at]], which[known[which] == g[at]]
    place = np.sort(which * len(b) + at)
    mine = np.searchsorted(known, h) * len(b)
    twice = np.searchsorted(place, mine + last + most, "right") - np.searchsorted(place, mine + first) > 1
    return text, first - starts[text], last - starts[text], h, stretch, twice


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def spans(docs: DataFrame, span: int = SPAN, hot: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(k1, k2, s int, e int)``: byte ranges to remove, by text key; they may overlap."""
    base = _keyed(docs, id_col, text_col)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.drop_duplicates(["k1", "k2"])
            k1, k2 = (pdf[c].to_numpy(np.int64) for c in ("k1", "k2"))
            key = mixed(k1.view(np.uint64) ^ mixed(k2.view(np.uint64)))
            for numbers, starts, b in blocks([t.encode("utf-8", "surrogatepass") for t in pdf["text"]]):
                text, first, last, h, c, twice = runs(starts, b, span)
                no = numbers[text]
                place = mixed(key[no] + first.astype(np.uint64) + np.uint64(1)).view(np.int64)
                yield pd.DataFrame({"k1": k1[no], "k2": k2[no], "a": first.astype(np.int32), "b": last.astype(np.int32), "h": h.view(np.int64), "c": c.view(np.int64), "twice": twice, "g": place})

    long_ = base.where(F.octet_length("text") >= span)
    rows = long_.select("k1", "k2", "text").mapInPandas(find, "k1 long, k2 long, a int, b int, h long, c long, twice boolean, g long")
    # 1. buckets
    bucket = rows.groupBy("h").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n"), F.max("twice").alias("any"))
    bucket = bucket.where("g0 < g1 or any").select("h", (F.col("c0") < F.col("c1")).alias("several"), (F.col("n") > hot).alias("hot"))
    rows = cut(rows.join(bucket, "h").distinct())
    # 2. stretches
    stretch = rows.groupBy("h", "c").agg(F.min("g").alias("g0"), F.max("g").alias("g1"))
    rows = rows.join(stretch, ["h", "c"]).withColumn("whole", F.col("g0") < F.col("g1"))
    whole = rows.where("whole").select("k1", "k2", F.col("a").alias("s"), (F.col("b") + span).alias("e"))
    # 3. single positions
    left = rows.where("(not whole and (several or twice)) or (whole and several and g = g0)")
    per_text = left.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b", "h", "hot")).alias("runs"))
    texts = base.join(per_text, ["k1", "k2"]).select("id", "text", "k1", "k2", "runs")

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for pdf in batches:
            out = []
            for k1, k2, t, some in zip(pdf["k1"], pdf["k2"], pdf["text"], pdf["runs"]):
                if (k1, k2) != before:  # copies of a text follow each other
                    raw = t.encode("utf-8", "surrogatepass")
                    out += [(k1, k2, r["a"], r["h"], r["hot"], raw[r["a"] : r["b"] + span]) for r in some]
                before = (k1, k2)
            yield pd.DataFrame(out, columns=["k1", "k2", "a", "h", "hot", "part"])

    parts = texts.mapInPandas(stretches, "k1 long, k2 long, a int, h long, hot boolean, part binary")

    def positions(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, offset in the run, identifier) of every string."""
        rows, offsets, found = [], [], []
        for numbers, starts, b in blocks(list(pdf["part"])):
            ids = strings(grams(b, span // 4), span // 4)
            n = np.append(starts[1:], len(b)) - starts - span + 1
            row = np.repeat(np.arange(len(n)), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows.append(numbers[row])
            offsets.append(offset)
            found.append(ids[starts[row] + offset])
        return np.concatenate(rows), np.concatenate(offsets), np.concatenate(found)

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket; whole buckets are taken together."""

        def search(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.drop_duplicates(["h", "k1", "k2", "a"]).reset_index(drop=True)
            row, offset, ids = positions(pdf)
            h = pdf["h"].to_numpy()[row]
            order = np.lexsort((ids, h))
            same = (ids[order][1:] == ids[order][:-1]) & (h[order][1:] == h[order][:-1])
            hit = np.zeros(len(ids), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            at = np.flatnonzero(hit)
            if not len(at):
                return pd.DataFrame({c: np.empty(0, t) for c, t in (("k1", "int64"), ("k2", "int64"), ("s", "int32"), ("e", "int32"))})
            new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(row[at]) > 0)])
            lo, hi = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
            a = pdf["a"].to_numpy()[row[lo]]
            return pd.DataFrame({"k1": pdf["k1"].to_numpy()[row[lo]], "k2": pdf["k2"].to_numpy()[row[lo]], "s": (a + offset[lo]).astype(np.int32), "e": (a + offset[hi] + span).astype(np.int32)})

        held: list[pd.DataFrame] = []
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo : lo + 2000]
                last = part["h"] == part["h"].iloc[-1]
                if held and held[-1]["h"].iloc[-1] != part["h"].iloc[0] or held and not last.all():
                    joined = pd.concat([*held, part[~last]])
                    yield search(joined)
                    held = []
                elif not last.all():
                    yield search(part[~last])
                held.append(part[last])
        if held:
            yield search(pd.concat(held))

    cool = parts.where("not hot").repartition("h").sortWithinPartitions("h").mapInPandas(within, "k1 long, k2 long, s int, e int")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500].reset_index(drop=True)
                row, offset, ids = positions(part)
                s = part["a"].to_numpy()[row] + offset
                yield pd.DataFrame({"h": part["h"].to_numpy()[row], "w": ids.view(np.int64), "k1": part["k1"].to_numpy()[row], "k2": part["k2"].to_numpy()[row], "s": s.astype(np.int32)})

    single = parts.where("hot").mapInPandas(spread, "h long, w long, k1 long, k2 long, s int")
    place = F.xxhash64("k1", "k2", "s")
    twice = single.groupBy("h", "w").agg(F.min(place).alias("g0"), F.max(place).alias("g1")).where("g0 < g1").select("h", "w")
    heated = single.join(twice, ["h", "w"]).select("k1", "k2", "s", (F.col("s") + span).cast("int").alias("e"))
    copies = long_.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("e")).where("n > 1").select("k1", "k2", F.lit(0).alias("s"), F.col("e").cast("int").alias("e"))
    return whole.unionByName(cool).unionByName(heated).unionByName(copies)


def remove(text: str, found: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is kept of a text, and how many bytes and maximal runs go."""
    raw = text.encode("utf-8", "surrogatepass")
    kept, at, n = [], 0, 0
    end = -1
    for s, e in sorted(found):
        if s > end:  # touching ranges are one run
            n += 1
            kept.append(raw[max(at, 0) : s])
        end = at = max(end, e)
    kept.append(raw[at:])
    out = b"".join(kept)
    return out, len(raw) - len(out), n


def without_repeats(docs: DataFrame, span: int = SPAN, hot: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept binary)`` for every row of ``docs``.

    ``kept`` may end within a character, as ranges are ranges of bytes; it is
    made of whole texts, however long. Extra columns are left out. A null
    text is empty; repeated rows are copies of each other, so all their bytes
    go if there are ``span`` of them. Empty tables give empty results.
    """
    if span % 4 or span < 8:
        raise ValueError("span must be a multiple of 4, 8 at least")
    prepare(docs.sparkSession)
    found = spans(docs, span, hot, id_col, text_col).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    rows = _keyed(docs, id_col, text_col).join(found, ["k1", "k2"], "left").select("id", "text", "k1", "k2", "found")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [remove(t, [(r["s"], r["e"]) for r in f] if f is not None else []) for t, f in zip(pdf["text"], pdf["found"])]
            kept = [x[0] for x in out]
            removed = np.array([x[1] for x in out], np.int64)
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": removed + np.array([len(x) for x in kept], np.int64), "n_removed": removed, "n_spans": np.array([x[2] for x in out], np.int64), "kept": kept})

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(apply, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.make_valid_utf8(F.col("kept").cast("string"))  # a range may end within a character
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), kept.alias("text"), (F.col("n_removed") > 0).alias("repeated"))
