"""SimHash near-duplicates over Gray-order hierarchical indexes.

Fingerprints within ``bits`` differing bits are linked; a group is what links
connect. The index is built over distinct fingerprints:

* a fingerprint is cut into ``bits + a`` blocks. Each choice of ``a`` blocks is
  an order: these blocks lead, and codes are sorted by Gray rank. Two codes
  within ``bits`` agree on ``a`` whole blocks, so in that order they lie under
  the same top node, the one that shares the blocks' bits. ``a`` follows the
  number of codes, so that a top node holds ``MEAN`` on average at most;
* under a top node, runs of neighbours in Gray rank form leaves, runs of
  leaves upper nodes. A node holds the bits that all its members share, as a
  mask and a pattern. Two nodes differ at least in the bits that both share;
  these differences accumulate downwards, and a pair of nodes above ``bits``
  is pruned with everything under it. So is a pair whose members are linked
  already;
* a top node with more than ``CHUNK`` members is cut into chunks by a hash,
  and each pair of chunks is a task group of its own, so that no node is ever
  gathered into one task.

A top node hands on at most one link for each member (to the root of its part
of the group), never its pairs; connected components then join the parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, prepare, read, small

SEED = 42
LEAF, FAN, CHUNK_PAIRS = 16, 8, 150_000
MEAN, CHUNK, CHUNKS, LARGEST = 512, 16384, 64, 1 << 19


def bit_majority(hashes: np.ndarray, n: int) -> int:
    """The code whose bits are set in over half of ``n`` hashes."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        ones += np.unpackbits(hashes[lo : lo + 65536].view(np.uint8).reshape(-1, 8)[:, ::-1], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Unsigned hashes, repeats included; of all words if they are fewer, none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def fingerprint(text: str | None, words: int) -> int:
    """A bit is set if over half the shingles' hashes have it; 0 without words."""
    hashes = shingle_hashes(text, words)
    return bit_majority(hashes, len(hashes))


def fingerprinted(docs: DataFrame, words: int, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_fp array<long>`` of one code; a null text has no words."""

    @F.pandas_udf("array<long>")
    def fps(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array([fingerprint(t, words)], np.uint64).view(np.int64) for t in texts], dtype=object)

    return docs.withColumn("_fp", fps(F.col(text_col)))


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Where 64-bit codes stand in the Gray sequence."""
    rank = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def linked(seg: np.ndarray, code: np.ndarray, bits: int) -> np.ndarray:
    """For each code the row number of its part's root; only equal ``seg`` link.

    ``seg`` and ``code`` must be sorted by seg, then by Gray rank.
    """
    n = len(code)
    label = np.arange(n)
    if n < 2:
        return label
    # Level 0 are rows; each level above holds runs of nodes of one segment.
    first_of = [np.arange(n + 1)]
    masks, patterns, segs, fan = [np.full(n, ~np.uint64(0))], [code], [seg], LEAF
    while True:
        s = segs[-1]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        if len(segs) > 1 and new.all():
            break
        at = np.flatnonzero(new)
        inside = np.arange(len(s)) - np.repeat(at, np.diff(np.append(at, len(s))))
        starts = np.flatnonzero(inside % fan == 0)
        ones = np.bitwise_and.reduceat(patterns[-1] & masks[-1], starts)
        zeros = np.bitwise_and.reduceat(~patterns[-1] & masks[-1], starts)
        masks.append(ones | zeros)
        patterns.append(ones)
        segs.append(s[starts])
        first_of.append(np.append(starts, len(s)))
        fan = FAN

    def spans() -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The least and greatest label under each node, by level."""
        low, high = [label], [label]
        for level in range(1, len(segs)):
            low.append(np.minimum.reduceat(low[-1], first_of[level][:-1]))
            high.append(np.maximum.reduceat(high[-1], first_of[level][:-1]))
        return low, high

    low, high = spans()
    top = len(segs) - 1
    tops = np.arange(len(segs[top]))
    stack = [(top, tops[lo : lo + 4096], tops[lo : lo + 4096]) for lo in range(0, len(tops), 4096)]
    while stack:
        level, a, b = stack.pop()
        alike = (low[level][a] == high[level][a]) & (low[level][b] == high[level][b]) & (low[level][a] == low[level][b])
        a, b = a[~alike], b[~alike]
        first = first_of[level]
        wide = (first[a + 1] - first[a]) * (first[b + 1] - first[b])
        ends = np.cumsum(wide)
        if len(a) > 1 and ends[-1] > CHUNK_PAIRS:
            half = max(1, min(len(a) - 1, int(np.searchsorted(ends, ends[-1] // 2))))
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        if not len(a):
            continue
        k = np.arange(ends[-1]) - np.repeat(ends - wide, wide)
        pair = np.repeat(np.arange(len(a)), wide)
        across = (first[b + 1] - first[b])[pair]
        x, y = first[a][pair] + k // across, first[b][pair] + k % across
        level -= 1
        keep = (x <= y) if level else (x < y)
        x, y = x[keep], y[keep]
        apart = np.bitwise_count((patterns[level][x] ^ patterns[level][y]) & masks[level][x] & masks[level][y])
        x, y = x[apart <= bits], y[apart <= bits]
        if not len(x):
            continue
        if level:
            cross = x != y
            stack += [(level, x[cross], y[cross]), (level, x[~cross], y[~cross])]
            continue
        while True:  # hook the greater root under the smaller one, then flatten
            u, v = label[x], label[y]
            open_ = u != v
            if not open_.any():
                break
            np.minimum.at(label, np.maximum(u, v)[open_], np.minimum(u, v)[open_])
            while (label[label] != label).any():
                label = label[label]
        low, high = spans()
    return label


def rotation(r: int) -> list[tuple[int, int]]:
    """The (first bit, length) of the parts of a code rotated by ``r``."""
    return [(r, 64 - r), (0, r)] if r else [(0, 64)]


def permuted(fp: Column, parts: list[tuple[int, int]]) -> Column:
    """The code with these parts of its bits in this order."""
    out, left = None, 64
    for first, n in parts:
        left -= n
        x = fp if n == 64 else F.shiftleft(F.shiftrightunsigned(fp, 64 - first - n).bitwiseAND(F.lit((1 << n) - 1)), left)
        out = x if out is None else out.bitwiseOR(x)
    return out


def agreeing(n: int, bits: int) -> list[tuple[int, list[tuple[int, int]], int]]:
    """Orders (lane 0, parts, head's width) that show every pair within ``bits`` under one head.

    Of ``bits + a`` blocks such a pair agrees on ``a``; each choice of a blocks
    leads one order. ``a`` is the least whose heads give nodes of ``MEAN``
    codes on average.
    """
    for a in range(1, 5):
        edge = [round(64 * t / (bits + a)) for t in range(bits + a + 1)]
        block = [(x, y - x) for x, y in zip(edge, edge[1:])]
        orders = [(0, [block[i] for i in some] + [x for i, x in enumerate(block) if i not in some], sum(block[i][1] for i in some)) for some in combinations(range(bits + a), a)]
        if n <= MEAN << min(w for _, _, w in orders):
            break
    return [(lane, parts, min(w, 32)) for lane, parts, w in orders]


def nodes(codes: DataFrame, orders: list[tuple[int, list[tuple[int, int]], int]]) -> DataFrame:
    """``(node, i, j, v, code)`` of ``codes(v, fp array<long>)``: the top nodes of every order.

    Rows of one (node, i, j) are together and sorted. A node of more than
    ``CHUNK`` members is cut into up to ``CHUNKS`` chunks by a hash, more only
    where a chunk would pass ``LARGEST``; i and j are a pair of its chunks.
    """
    each = []
    for t, (lane, parts, width) in enumerate(orders):
        code = permuted(F.get(F.col("fp"), lane), parts)
        each.append(F.struct(code.alias("code"), (F.lit(t * (1 << 32)) + F.shiftrightunsigned(code, 64 - width)).alias("node")))
    rows = codes.select("v", F.explode(F.array(*each)).alias("o")).select("v", "o.code", "o.node")
    parts_of = F.greatest(F.least(F.ceil(F.col("n") / CHUNK), F.lit(CHUNKS)), F.ceil(F.col("n") / LARGEST)).cast("int")
    hot = rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("node", parts_of.alias("parts"))
    rows = rows.join(small(hot), "node", "left").withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    rows = rows.select("v", "code", "node", "part", other.alias("other")).select("node", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "v", "code")
    return rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")


def by_node(search: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For ``mapInPandas`` over ``nodes``: whole nodes go to ``search(seg, name, v, code)``.

    Rows are sorted by ``seg``, the number of the node, then by Gray rank;
    ``name`` is a hash of the node.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            node, i, j = (pdf[c].to_numpy(np.int64) for c in ("node", "i", "j"))
            seg = np.concatenate([[0], np.cumsum((node[1:] != node[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))])
            code = pdf["code"].to_numpy(np.int64).view(np.uint64)
            order = np.lexsort((gray_rank(code), seg))
            name = (node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + i.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) + j.astype(np.uint64)
            return search(seg[order], name[order], pdf["v"].to_numpy(np.int64)[order], code[order])

        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            key = list(pdf[["node", "i", "j"]].iloc[-1])
            last = (pdf["node"] == key[0]) & (pdf["i"] == key[1]) & (pdf["j"] == key[2])
            if not last.all():
                yield whole(pd.concat([*held, pdf[~last]]))
                held = []
            elif held and list(held[-1][["node", "i", "j"]].iloc[-1]) != key:
                yield whole(pd.concat(held))
                held = []
            held.append(pdf[last])
        if held:
            yield whole(pd.concat(held))

    return run


def links(codes: DataFrame, bits: int) -> DataFrame:
    """``(u, v)``: for distinct ``codes(v, fp array<long>)``, links that connect each group."""

    def search(seg: np.ndarray, name: np.ndarray, v: np.ndarray, code: np.ndarray) -> pd.DataFrame:
        root = linked(seg, code, bits)
        some = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"u": v[root[some]], "v": v[some]})

    return nodes(codes, agreeing(codes.count(), bits)).mapInPandas(by_node(search), "u long, v long")


def _grouped(rows: DataFrame, bits: int) -> DataFrame:
    """``(v, root, m)`` for ``rows(id, v, fp)``: each code's part and smallest id."""
    codes = rows.groupBy("v").agg(F.min("id").alias("m"), F.min("fp").alias("fp"))
    roots = components(links(codes.select("v", "fp"), bits))
    return codes.select("v", "m").join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root"), "m")


def near_groups(docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component_id)``, one row for each row of ``docs``.

    ``component_id`` is the smallest id reachable; null ids take part but are
    never the smallest, so a group of null ids only has null. Repeated rows
    and equal texts share a fingerprint and hence a group. Texts without words
    have fingerprint 0. Very long texts are taken whole. Extra columns are
    left out. Empty tables give empty results.
    """
    prepare(docs.sparkSession)
    rows = fingerprinted(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), words, "_text")
    rows = cut(rows.select("id", F.get("_fp", 0).alias("v"), F.col("_fp").alias("fp")))
    grouped = _grouped(rows, bits)
    least = grouped.groupBy("root").agg(F.min("m").alias("component_id"))
    return rows.select("id", "v").join(grouped.select("v", "root").join(least, "root").select("v", "component_id"), "v").select("id", F.col("v").alias("fp"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_groups(docs)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
