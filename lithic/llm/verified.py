"""Groups of texts whose word shingles overlap by ``alike`` (Jaccard) or more.

SimHash proposes, the sets decide. A text is the set of its word shingles; its
fingerprint has several lanes of 64 bits, taken over the set. Two sets that
overlap by J (of about equal size) differ in each bit with the chance
``acos(2J / (1 + J)) / pi``, 0.15 at 0.8. In each of several Gray orders a
lane's codes stand under top nodes that share a head of ``width`` bits; under
a node the hierarchical index finds the codes within ``near`` bits. The width
follows the number of sets, so that nodes stay small, and the number of orders
follows the width, so that a pair at exactly ``alike`` shares a head in one of
them with a chance of ``RECALL``; more alike pairs are surer.

What an index holds together is a knot of sets. Pairs are decided by both
sets, never by bits alone:

* first, what knots connect is held against one of its sets, the one whose
  code is nearest to the majority of their codes: the source of copies, or
  the copy most like it. A large group is then nearly always one part, though
  its pairs were never listed;
* then each set that is not yet in one part with all of its knots is held
  against the most central set of one of them;
* then all pairs of a knot of ``FEW`` sets at most that are within ``near``
  bits and still in different parts are held against each other. What larger
  knots connect is not listed in pairs: a prefix join over differences from a
  pivot finds every pair that is alike (``by_pivot``).

Before its sets are looked at, a pair of knots must pass two filters: their
sizes must allow the overlap, and their lanes, of which there are ``WIDE`` at
least, must not differ together by far more than ``alike`` would. Sets are
compared as 32-bit hashes of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, held, prepare, small, whole
from .simhash import SEED, bit_majority, by_node, linked, nodes, rotation, shingle_hashes

RECALL, TURNS, ORDERS, WIDE, MEAN = 0.95, 1, 5, 8, 16
FEW, STEPS, CROWD = 32, 12, 0.125


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct unsigned hashes, sorted; of all words if they are fewer, none without words."""
    return np.unique(shingle_hashes(text, words))


def differing(alike: float) -> float:
    """The chance that a bit differs between two sets that overlap by ``alike``."""
    return math.acos(2 * alike / (1 + alike)) / math.pi


def plan(n: int, alike: float) -> tuple[int, int, int, int]:
    """(lanes in the index, width, bits of one lane, bits of all lanes) for ``n`` sets."""
    width = min(30, max(12, math.ceil(math.log2(max(1, n) / MEAN))))
    p = differing(alike)
    lanes = max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - p) ** width) / ORDERS))
    far = lambda m: math.ceil(m * p + 2.5 * math.sqrt(m * p * (1 - p)))
    rest = 64 - width  # what is left of a code once its head agrees
    return lanes, width, math.ceil(rest * p + 1.6 * math.sqrt(rest * p * (1 - p))), far(64 * max(WIDE, lanes))


def sketch(text: Column, words: int, lanes: int) -> Column:
    """``struct<v long, s binary, n int, fp array<long>>``: the set's hash, its digest, size and fingerprint."""

    @F.pandas_udf("v long, s binary, n int, fp array<long>")
    def udf(texts: pd.Series) -> pd.DataFrame:
        held("no object")
        out = []
        for t in texts:
            h = shingles(t, words)
            raw = h.tobytes()
            fp = np.array([bit_majority(x, len(h)) for x in lanes_of(h, lanes)], np.uint64)
            out.append((int(np.uint64(xxhash.xxh64_intdigest(raw, SEED)).view(np.int64)), xxhash.xxh128_digest(raw), len(h), fp.view(np.int64)))
        return pd.DataFrame(out, columns=["v", "s", "n", "fp"])

    return udf(text)


def lanes_of(h: np.ndarray, lanes: int) -> Iterator[np.ndarray]:
    """The hashes themselves, then a bijection of them for each further lane."""
    yield h
    for _ in range(lanes - 1):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(28)
        yield h


def knots(codes: DataFrame, lanes: int, width: int, near: int) -> DataFrame:
    """``(knot, v, code, d)``: sets that an index links within ``near`` bits, for ``codes(v, fp)``.

    ``d`` is how far a code is from the majority of its knot.
    """
    orders = [(lane, rotation(round(64 * t / ORDERS)), width) for lane in range(lanes) for t in range(ORDERS)]

    def search(seg: np.ndarray, name: np.ndarray, v: np.ndarray, code: np.ndarray) -> pd.DataFrame:
        root = linked(seg, code, near)
        n = np.bincount(root, minlength=len(root))[root]
        at = np.flatnonzero(n > 1)
        at = at[np.argsort(root[at], kind="stable")]
        if not len(at):
            return pd.DataFrame({"knot": at, "v": at, "code": at, "d": at})
        starts = np.flatnonzero(np.concatenate([[True], root[at][1:] != root[at][:-1]]))
        size = np.diff(np.append(starts, len(at)))
        centre = np.zeros(len(starts), np.uint64)
        for bit in range(64):
            ones = np.add.reduceat((code[at] >> np.uint64(bit)) & np.uint64(1), starts)
            centre |= (2 * ones > size).astype(np.uint64) << np.uint64(bit)
        d = np.bitwise_count(code[at] ^ np.repeat(centre, size))
        knot = (v[root[at]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ name[at]
        return pd.DataFrame({"knot": knot.view(np.int64), "v": v[at], "code": code[at].view(np.int64), "d": d.astype(np.int32)})

    return nodes(codes, orders).mapInPandas(by_node(search), "knot long, v long, code long, d int")


def by_pivot(groups: DataFrame, sets: DataFrame, alike: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links ``(u, v)`` with pivots, candidates ``(u, v)``, and ``(c, v)`` that another pivot must see.

    For ``groups(c, u, v, root)``, u being the pivot of c, and ``sets(v, s)``.
    Where u is null the pivot is the empty set, and all pairs are candidates.
    Of two alike sets that are both near the pivot and not both alike to it
    each pair of different roots is a candidate; of two others, both are far
    enough to be handed on. ``1 - J`` is a metric, so there is no third case.

    Let D be how a set differs from the pivot, with what it lacks. Two sets
    differ in as many elements as their Ds do, ``r`` of their sizes' sum at most
    if they are alike. If one is not alike to the pivot, then its D is too large
    for this unless the Ds overlap, by ``(|Dx| + |Dy| - r (|x| + |y|)) / 2``.
    Elements are ordered by how many Ds have them, rarest first; so many may
    be missing that the first common one stands within a prefix of either D.
    Elements of one D only come first and need no row. The sizes of the Ds are
    cut into strata (by ratio, where D is the set itself), and a pair meets by
    the stratum of its smaller D and how many strata the larger is above, as
    the prefixes depend on both.
    """
    r, wide = (1 - alike) / (1 + alike), min(1.0, 3 * (1 - alike))
    pivots = groups.where("u = v").join(sets, "v").select("c", F.col("s").alias("p"), F.col("root").alias("first"))
    rows = groups.where("u is null or u <> v").join(sets, "v").join(small(pivots, 2000), "c", "left")
    rows = rows.withColumn("p", F.coalesce("p", F.array().cast("array<int>")))
    rows = rows.withColumn("lacks", F.array_except("p", "s")).withColumn("has", F.array_except("s", "p"))
    k, n = F.size("lacks") + F.size("has"), F.size("s")
    far = F.when(F.col("u").isNotNull(), k / (n + F.size("lacks")))  # no distance from no pivot
    main = F.coalesce((F.col("root") == F.col("first")) | (far <= 1 - alike + 1e-9), F.lit(False))
    d = F.when(far.isNull() | (far <= wide + 1e-9), F.concat("lacks", "has"))
    rows = cut(rows.select("c", "u", "v", "root", main.alias("main"), n.alias("n"), F.size("p").alias("m"), k.alias("k"), far.alias("far"), d.alias("d")))
    links = rows.where(F.col("far") <= 1 - alike + 1e-9).select("u", "v")
    rest = rows.where(F.col("far") > wide - (1 - alike) - 1e-9).select("c", "v")
    near = rows.where(F.col("d").isNotNull())
    each = near.select("c", "v", F.explode("d").alias("t"))
    shared = each.groupBy("c", "t").agg(F.count("*").alias("o")).where("o > 1")
    order = each.join(shared, ["c", "t"]).groupBy("c", "v").agg(F.sort_array(F.collect_list(F.struct("o", "t"))).alias("order"))
    most, step = r * F.col("n") * (1 + 1 / alike), F.greatest(F.ceil(F.col("m") / STEPS), F.lit(1))
    placed = near.join(order, ["c", "v"]).withColumn("most", most).withColumn("step", F.when(F.col("u").isNotNull(), step))
    placed = placed.select("c", "v", "root", "main", "n", "k", "most", "step", F.size("order").alias("some"), F.posexplode("order").alias("i", "x"))
    placed = placed.withColumn("pos", F.col("k") - F.col("some") + F.col("i") + 1).withColumn("t", F.col("x.t")).where(F.col("pos") <= F.col("most") + 1 + 1e-9)
    above = F.greatest(F.floor((F.col("most") - 1) / F.col("step")) + 1, F.lit(0))
    placed = placed.withColumn("e", F.explode(F.sequence(F.lit(0), F.coalesce(above, F.lit(5)).cast("int"))))
    ratio = alike**-0.25
    least = F.coalesce((F.col("e") - 1) * F.col("step") + 1, F.col("k") * (F.pow(F.lit(ratio), F.col("e") - 1) - 1))
    greatest = F.coalesce((F.col("e") + 1) * F.col("step") - 1, F.col("k") * (1 - F.pow(F.lit(ratio), -F.col("e") - 1)))
    greatest = F.least("most", greatest)
    lower = F.when(F.col("e") == 0, F.least("most", F.coalesce(F.col("step") - 1, F.col("k") * (ratio - 1)))).otherwise(-least)  # in one stratum either may be the larger
    stratum = F.floor(F.coalesce(F.col("k") / F.col("step"), F.log("k") / math.log(ratio)))

    def side(limit: Column, at: Column, name: str) -> DataFrame:
        found = placed.where(F.col("pos") <= (F.col("most") + limit) / 2 + 1 + 1e-9)
        return found.select("c", "t", "e", at.alias("stratum"), *[F.col(x).alias(x + name) for x in ("v", "root", "main", "n", "k", "pos")])

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        slack = r * (F.col("nx") + F.col("ny")) + 2 + 1e-9
        ok = (F.col("rootx") != F.col("rooty")) & (F.least("nx", "ny") >= alike * F.greatest("nx", "ny") - 1e-9)
        ok &= (2 * F.col("posx") <= F.col("kx") - F.col("ky") + slack) & (2 * F.col("posy") <= F.col("ky") - F.col("kx") + slack)
        ok &= (F.col("e") > 0) | F.col("mainy") | (F.col("vx") < F.col("vy"))  # one way round
        return a.join(b, ["c", "t", "e", "stratum"]).where(ok).select(F.least("vx", "vy").alias("u"), F.greatest("vx", "vy").alias("v"))

    x, y = side(lower, stratum, "x"), side(greatest, stratum - F.col("e"), "y")
    pairs = joined(x.where("not mainx"), y).unionAll(joined(x.where("mainx and e > 0"), y.where("not mainy")))
    return links, pairs.distinct(), rest


def alike_parts(rows: DataFrame, texts: DataFrame, words: int, alike: float, near: int, far: int, lanes: int, width: int) -> DataFrame:
    """``(v, root)`` of each set of ``rows(v, n, k, fp)`` that is not its part's root.

    ``k`` names a text of ``texts(k, text)`` that has the set; rows may repeat.
    """
    codes = cut(rows.groupBy("v").agg(F.min(F.struct("k", "n", "fp")).alias("o")).select("v", "o.k", "o.n", "o.fp"))
    tied = cut(knots(codes.select("v", "fp"), lanes, width, near))
    members = cut(codes.join(tied.select("v").distinct(), "v", "left_semi"))

    @F.pandas_udf("array<int>")
    def sets(t: pd.Series) -> pd.Series:
        return pd.Series([np.unique((shingles(x, words) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for x in t], dtype=object)

    def differ(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)

    def overlapping(both: DataFrame) -> DataFrame:
        inter = F.size(F.array_intersect("x", "y"))
        return both.where(inter / (F.size("x") + F.size("y") - inter) >= alike - 1e-9).select("u", "v")

    def decided(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(u, v)`` whose sets are alike; sets are made of their texts again."""
        a = members.select(F.col("v").alias("u"), F.col("k").alias("ku"), F.col("n").alias("nu"), F.col("fp").alias("x"))
        pairs = pairs.join(a, "u").join(members.select("v", F.col("k").alias("kv"), F.col("n").alias("nv"), F.col("fp").alias("y")), "v")
        pairs = cut(pairs.where((F.least("nu", "nv") >= alike * F.greatest("nu", "nv") - 1e-9) & (differ("x", "y") <= far)).select("ku", "kv", "u", "v"))
        if pairs.isEmpty():
            return pairs.select("u", "v")
        need = pairs.select(F.col("ku").alias("k")).unionByName(pairs.select(F.col("kv").alias("k"))).distinct()
        found = texts.join(small(need), "k", "left_semi").dropDuplicates(["k"])
        found = cut(found.select("k", sets(F.col("text")).alias("s")))
        both = pairs.join(found.select(F.col("k").alias("kv"), F.col("s").alias("y")), "kv")
        both = both.join(found.select(F.col("k").alias("ku"), F.col("s").alias("x")), "ku")
        return cut(overlapping(both))

    def central(tied: DataFrame) -> DataFrame:
        """``(c, u, v)``: each set of what knots connect with the most central one, u."""
        star = tied.join(tied.groupBy("knot").agg(F.min("v").alias("u")), "knot").select("u", "v")
        code = members.join(tied.select("v").distinct(), "v", "left_semi").join(components(star), "v", "left")
        code = code.select("v", F.coalesce("root", "v").alias("c"), F.get("fp", 0).alias("code"))
        code = cut(code)
        ones = [F.sum(F.shiftrightunsigned("code", i).bitwiseAND(1)).alias(f"b{i}") for i in range(64)]
        bits = [F.when(2 * F.col(f"b{i}") > F.col("n"), F.lit((1 << i) - (1 << 64 if i == 63 else 0))).otherwise(F.lit(0)) for i in range(64)]
        centre = code.groupBy("c").agg(F.count("*").alias("n"), *ones).select("c", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("centre"))
        pivot = code.join(centre, "c").groupBy("c").agg(F.min(F.struct(F.bit_count(F.col("code").bitwiseXOR(F.col("centre"))), F.col("v").alias("u"))).alias("p"))
        return code.join(pivot.select("c", "p.u"), "c").select("c", "u", "v")

    def sized(tied: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of knots of ``FEW`` sets at most, and of larger ones."""
        n = tied.groupBy("knot").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("knot")
        return tied.join(n, "knot", "left_anti"), cut(tied.join(n, "knot", "left_semi"))

    def in_large(tied: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of ``tied(knot, v, code, root)``, knots of over ``FEW`` sets; and rows whose pairs are left, in small knots."""
        need = members.join(tied.select("v").distinct(), "v", "left_semi").select("k", "v")
        found = texts.join(small(need), "k").dropDuplicates(["v"])
        found = cut(found.select("v", sets(F.col("text")).alias("s")))
        links, few, scattered, turns = yes, tied.where("false"), None, 0
        while True:
            groups = scattered
            if not tied.isEmpty():
                groups = central(tied).join(tied.select("v", "root").distinct(), "v")
                apart = groups.groupBy("c").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where("a < b")
                groups = cut(groups.join(apart.select("c", "n"), "c"))
            elif groups is None:
                return links, few
            direct, pairs, rest = by_pivot(groups, found, alike)
            both = cut(pairs).join(found.select(F.col("v").alias("u"), F.col("s").alias("x")), "u")
            both = both.join(found.select("v", F.col("s").alias("y")), "v")
            links = links.unionByName(direct).unionByName(cut(overlapping(both)))
            if groups is scattered:
                return links, few
            # Where hardly any set is near the pivot there is no crowd, and the empty set serves as well.
            rest = cut(groups.join(rest, ["c", "v"], "left_semi").select("c", "v", "root", "n"))
            thin = rest.groupBy("c", "n").agg(F.count("*").alias("left")).where(F.col("left") > (1 - CROWD) * F.col("n")).select("c")
            loose = rest.join(thin, "c", "left_semi").select(F.xxhash64("c", F.lit(turns)).alias("c"), F.lit(None).cast("long").alias("u"), "v", "root")
            scattered = loose if scattered is None else scattered.unionByName(loose)
            less, tied = sized(cut(tied.join(rest.join(thin, "c", "left_anti").select("v"), "v", "left_semi")))
            few, turns = few.unionByName(less), turns + 1

    close = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= near
    pair = (F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    yes = members.select(F.col("v").alias("u"), "v").where("false")
    if tied.isEmpty():
        return yes.select("v", F.col("u").alias("root"))
    place = F.row_number().over(Window.partitionBy("knot").orderBy("d", F.xxhash64("v")))
    tried, roots = yes, None
    for turn in range(TURNS + 2):
        if not turn:
            pairs = central(tied).where("u <> v").select("u", "v")
        else:
            now = tied.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
            apart = now.groupBy("knot").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("knot")
            tied = cut(now.join(apart, "knot", "left_semi").drop("root"))
            if tied.isEmpty():
                break
            now = cut(tied.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")))
            if turn <= TURNS:
                others = now.withColumn("place", place).where(F.col("place") == turn)
            else:
                now, large = sized(now)
                if not large.isEmpty():
                    links, few = in_large(large)
                    yes, now = yes.unionByName(links), cut(now.unionByName(few))
                others = now
            others = others.select("knot", F.col("v").alias("u"), F.col("code").alias("c"), F.col("root").alias("r"))
            pairs = now.join(others, "knot").where((F.col("r") != F.col("root")) & close("c", "code"))
            if turn <= TURNS:  # one for each set
                pairs = pairs.groupBy("v").agg(F.min(F.struct(F.xxhash64("u", "v", F.lit(turn)), "u")).alias("p")).select("p.u", "v")
        pairs = cut(pairs.select(*pair).distinct().join(tried, ["u", "v"], "left_anti"))
        tried = tried.unionByName(pairs)
        yes = yes.unionByName(decided(pairs))
        roots = components(yes)
    return roots


def drop_near_copies(docs: DataFrame, words: int = 5, alike: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest id.

    Two texts are near copies if the sets of their word shingles overlap by
    ``alike`` (Jaccard) or more; a group is what they connect. Texts without
    words are near copies of each other; null is a text without words. Of rows
    that repeat id and text one stays; of a group without ids one row stays.
    Very long texts are sets like any other. Same columns, whatever their
    names; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    marked = docs.select(whole(docs), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("k", F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = marked.select("k", "text")
    lanes, width, near, far = plan(docs.count(), alike)
    rows = cut(marked.select("id", "k", sketch(F.col("text"), words, max(WIDE, lanes)).alias("o")).select("id", "k", "o.*"))
    roots = alike_parts(rows, texts, words, alike, near, far, lanes, width)
    roots = cut(roots.unionByName(roots.select(F.col("root").alias("v"), "root")).distinct())
    # A set that nothing is alike to is named by its digest, so that no two of them share a name.
    firsts = rows.groupBy("s").agg(F.min("v").alias("v"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("f"))
    firsts = firsts.join(roots, "v", "left").groupBy("root", F.when(F.col("root").isNull(), F.col("s")).alias("s")).agg(F.min("f").alias("f"))
    firsts = firsts.select(F.col("f.id").alias("m"), F.col("f.k").alias("mk"))
    counts = rows.groupBy("k", "id").agg(F.count("*").alias("n"))
    same = (F.col("k") == F.col("mk")) & F.col("id").eqNullSafe(F.col("m"))
    firsts = cut(firsts.join(counts, same).select("mk", "m", "n"))
    kept = marked.drop("text").join(firsts, same)
    once = kept.where("n > 1").dropDuplicates(["k"])
    return kept.where("n = 1").unionByName(once).select("row.*")
