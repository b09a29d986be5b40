"""Toxicity scores of restored text: a noisy channel, then a word model.

Restoring. A token that may be disguised (digits or signs among letters, runs
of one letter, letters set apart by spaces, dots or dashes, masked letters)
spans a lattice of characters: each sign may stand for the letters it looks
like, a run for one or two of its letter, a separator for nothing or for the
gap between two words (a wide one rather for a gap), ``*`` for any letter.
Viterbi finds the likeliest path under a trigram character model
counted over all documents, times the channel's costs. Tokens whose lattice
has a single path are kept as they are.

Scoring. On labelled rows (about ``sample`` of each class, chosen by a hash of
their id, never a held-out one) every restored word and the stems it may have
(its first letters) are counted, by documents and by distinct contexts (the
words before and after); the smaller count holds, so that copies of one
passage, or one long text, count once. Bayes' rule under the class shares of
all labelled training rows gives each the chance that a text which has it is
toxic; those above ``chance``, seen often enough, are the features. A text's
evidence is that of a noisy or over its different tokens, the best feature of
each; a logistic curve of one variable, fitted on the same rows, turns the
evidence into the score. A score uses nothing but the text.
"""

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, prepare, read

#: What a sign may stand for (fixed values of the channel).
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "*": "abcdefghijklmnopqrstuvwxyz",
}
SUBSTITUTED, MASKED, DROPPED = 1.0, 3.5, 0.3
#: What a separator costs as nothing and as a gap, by its width.
NARROW, WIDE = (0.3, 2.0), (2.0, 0.3)
SPACED_STEP = 64
MASKS = 6  # a longer run of masks is noise
A = 28  # a-z, 26 a gap, 27 any other letter
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$!|+") + "«»“”„’‘…–—"
NOISE = re.compile(r"([^\w\s*])\1\1+|\*{%d,}" % (MASKS + 1))
RUN = re.compile(r"(.)\1+")
SPACED = re.compile(r"(?<![^\W_])[^\W_@$!|+*](?:[\s.\-_*]{1,3}[^\W_]|[\s.\-_]{1,3}[@$!|+]){3,}(?![^\W_])")
SEPARATOR = re.compile(r"([\s.\-_]+)")
INNER = re.compile(r"[^\w@$!|+*]+|_+")

_LETTER = np.full(256, 26, np.int64)
_LETTER[128:] = 27
_LETTER[97:123] = np.arange(26)


def trigrams(texts: Iterator[str]) -> np.ndarray:
    """Counts of letter trigrams; gaps of any length are one gap."""
    out = np.zeros(A**3, np.int64)
    for text in texts:
        x = _LETTER[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
        x = x[np.concatenate([[True], (x[1:] != 26) | (x[:-1] != 26)])]
        x = np.concatenate([[26], x])
        out += np.bincount((x[:-2] * A + x[1:-1]) * A + x[2:], minlength=A**3) if len(x) > 2 else 0
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), interpolated with bigrams and single letters."""
    c = counts.reshape(A, A, A).astype(float)
    one = (c.sum((0, 1)) + 1) / (c.sum() + A)
    two = (c.sum(0) + 5 * one) / (c.sum((0, 2))[:, None] + 5)
    three = (c + 5 * two[None]) / (c.sum(2)[:, :, None] + 5)
    return -np.log(three)


class Restorer:
    """Restores disguised tokens; holds the channel and the character model."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    def arcs(self, token: str) -> list[list[tuple[str, float]]]:
        """For each run of the token the strings that it may stand for."""
        out = []
        for m in re.finditer(r"[\s.\-_]+|(.)\1*", token):
            c, n = m[1], len(m[0])
            if c is None:
                nothing, gap = NARROW if n == 1 else WIDE
                out.append([("", nothing), (" ", gap)])
            elif c == "*" and n > 1:
                out += [[(x, MASKED) for x in LOOKS[c]]] * n
            elif c.isalpha():
                out.append([(c, DROPPED * (n > 1)), *([(c + c, 0.0)] if n > 1 else [])])
            elif c in LOOKS:
                cost = MASKED if c == "*" else SUBSTITUTED
                some = [(x, cost) for x in LOOKS[c]]
                if n > 1:
                    some += [(x * min(n, 2), cost) for x in LOOKS[c]]
                out.append(some)
            else:
                out.append([("", DROPPED)])
        return out

    def viterbi(self, token: str) -> str:
        """The likeliest reading; a space parts words."""
        live = {(26, 26): (0.0, "")}
        costs = self.costs
        for arcs in self.arcs(token):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, read_) in live.items():
                for letters, extra in arcs:
                    x, y, total = a, b, cost + extra
                    for c in letters:
                        k = ord(c) - 97
                        k = k if 0 <= k < 26 else 26 if c == " " else 27
                        total += costs[x][y][k]
                        x, y = y, k
                    old = after.get((x, y))
                    if old is None or total < old[0]:
                        after[x, y] = (total, read_ + letters)
            live = after
        return min((cost + costs[a][b][26], word) for (a, b), (cost, word) in live.items())[1]

    def words(self, token: str) -> tuple[str, ...]:
        """The words that one token, lower-cased and without spaces, restores to."""
        core = NOISE.sub("", token.strip(EDGES)).strip(EDGES)
        if core.isalpha():
            if len(RUN.sub(r"\1\1", core)) != len(core):
                core = self.viterbi(core)
            short = RUN.sub(r"\1", core)
            return (core,) if short == core else (core, short)
        parts = [p for p in INNER.split(core) if p]
        if len(parts) > 2 and max(map(len, parts)) <= 2:
            parts = ["".join(parts)]
        elif len(parts) == 2:  # one separator: two words, or one that it parts
            parts.append("".join(parts))
        out = []
        for p in parts:
            if p.isalpha():
                out.append(p)
            elif any(c.isalpha() for c in p):
                bare = p.rstrip("!|+*")
                out += {self.viterbi(p), self.viterbi(bare) if bare else ""}
        return tuple(w for w in out if w) + tuple({RUN.sub(r"\1", w) for w in out} - set(out) - {""})

    def spaced(self, text: str) -> list[str]:
        """Words whose letters are set apart, in a lower-cased text."""
        out = []
        for m in SPACED.finditer(text):
            if any(c.isalpha() for c in m[0]):
                # Long runs in parts, so that none is walked as a whole; the parts meet at a separator.
                some = SEPARATOR.split(m[0])
                for lo in range(0, len(some), SPACED_STEP):
                    out += self.viterbi("".join(some[lo : lo + 2 * SPACED_STEP])).split()
                if len(some) <= SPACED_STEP:  # as one word
                    out.append(self.viterbi(SEPARATOR.sub("", m[0])))
        return out


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1536, chance: float = 0.6, least: int = 5, least_share: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The character model over all of ``docs`` and the word model of ``labels(id, toxic)``.

    Without labels of both classes every score is the share of toxic ones (0
    if there are none).
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(A**3, np.int64)
        for pdf in batches:
            total += trigrams(iter(pdf["text"]))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    counts = np.zeros(A**3, np.int64)
    for r in docs.select(text).mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r["gram"]] = r["n"]  # 28**3 rows at most
    model = {"lm": language_model(counts), "words": {}, "slope": 0.0, "base": 0.0, "no": uuid.uuid4().hex}

    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max("toxic").alias("y"))
    share = {r["y"]: r["n"] for r in known.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if not share.get(0) or not share.get(1):
        model["base"] = math.inf if share.get(1) else -math.inf
        return model
    y = (F.col("y") > 0).cast("int")
    draw = F.pmod(F.xxhash64(id_col), F.when(y == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    picked = known.select(id_col, y.alias("y")).where(draw < sample)  # about 2 * sample rows: small by the parameter
    rows = docs.select(id_col, text).join(F.broadcast(picked), id_col).select("y", "text")
    restorer = docs.sparkSession.sparkContext.broadcast(model["lm"])

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = Restorer(restorer.value)
        for pdf in batches:
            seen: set[tuple[str, int, int, int]] = set()
            for y, t in zip(pdf["y"], pdf["text"]):
                low, doc = t.lower(), xxhash.xxh64_intdigest(t) >> 1
                line = low.split()
                for i, token in enumerate(line):
                    some = features(restore.words(token))
                    around = xxhash.xxh64_intdigest(" ".join(line[max(0, i - 1) : i] + ["|"] + line[i + 1 : i + 2])) >> 1
                    seen.update((w, y, around, doc) for w in some)
                seen.update((w, y, doc, doc) for w in features(restore.spaced(low)))
            yield pd.DataFrame(list(seen), columns=["word", "y", "around", "doc"])

    found = rows.mapInPandas(contexts, "word string, y int, around long, doc long")
    one = lambda y, c: F.size(F.collect_set(F.when(F.col("y") == y, F.col(c))))  # noqa: E731  at most the sample's words
    found = found.groupBy("word").agg(F.least(one(1, "around"), one(1, "doc")).alias("t"), one(0, "doc").alias("n"))
    size = {r["y"]: r["n"] for r in picked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    a, b = share[1] / sum(share.values()) / max(1, size.get(1, 0)), share[0] / sum(share.values()) / max(1, size.get(0, 0))
    found = found.where(F.col("t") >= max(least, least_share * size.get(1, 0))).withColumn("p", F.col("t") * a / (F.col("t") * a + (F.col("n") + 1) * b))
    model["words"] = {r["word"]: -math.log1p(-r["p"]) for r in found.where(F.col("p") > chance).collect()}  # words of the sample only
    chosen = docs.sparkSession.sparkContext.broadcast(model | {"no": uuid.uuid4().hex})

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scorer = scorer_of(chosen.value)
            yield pd.DataFrame({"y": pdf["y"], "e": [scorer.evidence(t) for t in pdf["text"]]})

    seen = rows.mapInPandas(evidence, "y int, e double").collect()  # two numbers for each row of the sample
    y, e = np.array([r["y"] for r in seen], float), np.array([r["e"] for r in seen], float)
    if len(seen):
        model["slope"], model["base"] = logistic(e, y, np.where(y > 0, a, b) * sum(size.values()))
    return model


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not under 0) and intercept of a logistic curve, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(2), np.diag([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ beta)
        beta -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(beta[0])), float(beta[1])


STEMS = (4, 5, 6, 7)


def features(words: tuple[str, ...] | list[str]) -> set[str]:
    """The words themselves and their stems."""
    return {f for w in words for f in (w, *("^" + w[:k] for k in STEMS if len(w) > k))}


class Scorer:
    """A model at work; remembers which tokens hold no feature."""

    def __init__(self, model: dict):
        self.restore, self.weights = Restorer(model["lm"]), model["words"]
        self.slope, self.base = model["slope"], model["base"]
        self.plain: set[str] = set()

    def best(self, words: tuple[str, ...] | list[str]) -> float:
        return max((self.weights[f] for f in features(words) & self.weights.keys()), default=0.0)

    def evidence(self, text: str | None) -> float:
        low = (text or "").lower()
        found: dict[str, float] = {}
        for token in set(low.split()) - self.plain:
            words = self.restore.words(token)
            best = self.best(words)
            if best:
                found[words[-1]] = best
            else:
                if len(self.plain) > 300_000:
                    self.plain.clear()
                self.plain.add(token)
        for word in self.restore.spaced(low):
            if best := self.best([word]):
                found[word] = best
        return math.fsum(found.values())

    def score(self, text: str | None) -> float:
        x = self.slope * self.evidence(text) + self.base
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def scorer_of(model: dict) -> Scorer:
    return held(f"scorer {model['no']}", lambda: Scorer(model))


def score_of(spark: SparkSession, text: Column, model: dict) -> Column:
    """The score, 0 to 1, of a text; a null text is empty. One pass, no shuffle."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        scorer = scorer_of(shared.value)
        return pd.Series([scorer.score(x) for x in texts], dtype="float64")

    return run(text)


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score double``, its text kept; an existing column of that name is replaced.

    Texts of any length are scored whole; an empty table stays empty.
    """
    return docs.withColumn("score", score_of(docs.sparkSession, F.col(text_col), model))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
