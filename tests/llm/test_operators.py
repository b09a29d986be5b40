"""Small and hard inputs, and brute force, for every operator of the list."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lithic.llm import ann, common, grid, licenses, mixing, pieces, pii, repeats, secrets, simhash, topk, toxicity, verified

LONG = "der lange text " * 12000
DOCS = [
    (1, "the same words here again and again", "en", "a"),
    (1, "the same words here again and again", "en", "a"),
    (2, "the same words here again and again", "en", None),
    (None, "a text without an id token=abcdef123", None, "b"),
    (None, None, None, None),
    (3, None, "en", "a"),
    (4, "", "en", "b"),
    (5, " \t\n ", "en", "b"),
    (6, LONG, "de", "a"),
    (7, "Licensed under the Apache License, Version 2.0.\nmail a.b@c.example now", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture
def docs(spark):
    """With extra columns whose names the operators use themselves."""
    extra = {c: F.lit(i) for i, c in enumerate(("row", "id", "key", "v", "h", "found", "score", "n_words", "spans", "ids", "_fp", "more", "blob", "size"))}
    return spark.createDataFrame(DOCS, SCHEMA).withColumns(extra)


@pytest.fixture
def none(docs):
    return docs.where("false")


def near_brute(texts, ids, words, bits):
    fps = [simhash.fingerprint(t, words) for t in texts]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(fps)):
        groups[find(i)].append(ids[i])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((ids[i], fps[i], least[find(i)]) for i in range(len(fps))), key=repr)


def plain_fingerprint(text, words):
    """Bit by bit, from the definition."""
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in [None, "", "one", "One two three four five SIX seven", "é É\x85x y z", LONG]:
        for words in (4, 5):
            assert simhash.fingerprint(t, words) == plain_fingerprint(t, words)


def test_near_groups(spark, docs, none):
    out = simhash.near_groups(docs, id_col="doc_id").collect()
    got = sorted(((r["id"], r["fp"] % 2**64, r["component_id"]) for r in out), key=repr)
    assert got == near_brute([d[1] for d in DOCS], [d[0] for d in DOCS], 4, 4)
    assert simhash.near_groups(none).count() == 0


def test_index_equals_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(12):
        n = int(rng.integers(1, 700))
        c = rng.integers(0, 2**63, 5).astype(np.uint64)[rng.integers(0, 5, n)]
        for _ in range(rng.integers(0, 8)):
            c = np.where(rng.random(n) < 0.7, c ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), c)
        seg = np.sort(rng.integers(0, 3, n))
        c = c[np.lexsort((simhash.gray_rank(c), seg))]
        near = (np.bitwise_count(c[:, None] ^ c[None]) <= 4) & (seg[:, None] == seg[None])
        label = np.arange(n)
        while (m := np.where(near, label[None], n).min(1)).tolist() != label.tolist():
            label = m
        assert (simhash.linked(seg, c, 4) == label).all()


@pytest.mark.parametrize(("mean", "chunk"), [(512, 64), (8, 16), (1, 2048)])
def test_hot_nodes_keep_their_links(spark, monkeypatch, mean, chunk):
    """One block of bits shared by all: over the chunk size, so split; one to four blocks lead."""
    monkeypatch.setattr(simhash, "MEAN", mean)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(1)
    codes = {0} | {sum(1 << rng.randrange(13, 64) for _ in range(rng.randrange(1, 4))) for _ in range(1500)}
    df = spark.createDataFrame([(c - 2**64 if c >> 63 else c,) for c in codes], "v long")
    found = common.components(simhash.links(df.select("v", F.array("v").alias("fp")), 4)).collect()
    label = {c: c for c in codes}
    a = np.array(sorted(codes), np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None]) <= 4
    lab = np.arange(len(a))
    while (m := np.where(near, lab[None], len(a)).min(1)).tolist() != lab.tolist():
        lab = m
    got = {r["v"] % 2**64: r["root"] % 2**64 for r in found}
    part = lambda c: got.get(c, c)
    groups = collections.defaultdict(set)
    for c, x in zip(a.tolist(), lab.tolist()):
        groups[x].add(part(c))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups) and label


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    root = {}
    for i in range(200):
        root[i] = i
    for _ in range(200):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = {r["v"]: r["root"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: r for v, r in root.items() if r != v}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_drop_near_copies(docs, none):
    kept = verified.drop_near_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    texts = [(r["text"] or "").split() for r in rows]
    assert len(texts) == len({tuple(t) for t in texts}) == 5
    assert [r["doc_id"] for r in rows if r["text"] == DOCS[0][1]] == [1]
    assert verified.drop_near_copies(none).count() == 0


def near_copies_brute(rows, words=5, alike=0.8):
    """The ids that stay: the smallest of each group of sets that overlap by ``alike`` or more."""
    ids = [r["doc_id"] for r in rows]
    found = [(r["text"] or "").encode().lower().split() for r in rows]
    sets = [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in found]
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= alike * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    groups = collections.defaultdict(list)
    for i, r in enumerate(root):
        groups[r].append(ids[i])
    return {min(g) for g in groups.values()}


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(12)
    texts = []
    for g in range(30):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(8):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 40)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(500)}"
            texts.append(" ".join(t))
    line = "one line that is said again and again "
    texts += [line * 30 + " ".join(f"y{g}{i}" for i in range(20)) for g in range(12)]  # low Jaccard, nearly equal counts
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = near_copies_brute(df.collect())
    assert {r["doc_id"] for r in verified.drop_near_copies(df.repartition(5)).collect()} == want and len(want) < len(texts) - 100


def edited(rng, base, low, high):
    t = list(base)
    for at in rng.sample(range(len(t)), rng.randint(low, high)):
        t[at] = f"x{rng.randrange(10**6)}"
    return t


def test_differences_from_a_pivot_show_every_alike_pair(spark):
    """No pair that is alike is missed, and of pairs that are nearly alike few are listed."""
    rng = random.Random(15)
    bases = [rng.sample(range(1000), 90) for _ in range(2)]
    sets, groups = [], []
    for v in range(500):
        s = list(rng.choice(bases))
        if v % 5 == 4:  # like an earlier one that may be far from the pivot
            s = list(sets[rng.randrange(len(sets))])
        for _ in range(rng.randint(0, 4) if v % 5 == 4 else rng.randint(5, 25)):
            s[rng.randrange(len(s))] = 1000 + rng.randrange(100_000)
            if rng.random() < 0.3 and len(s) > 40:
                s.pop(rng.randrange(len(s)))
        sets.append(sorted(set(s)))
        groups.append((v % 2, v % 2, v, rng.randrange(500) if v % 10 < 3 else v))
    near = lambda a, b: len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))
    links, pairs, rest = verified.by_pivot(spark.createDataFrame(groups, "c long, u long, v long, root long"), spark.createDataFrame(list(enumerate(sets)), "v long, s array<int>"), 0.8)
    links, listed = {(r["u"], r["v"]) for r in links.collect()}, pairs.collect()
    pairs, rest = {(r["u"], r["v"]) for r in listed}, {r["v"] for r in rest.collect()}
    assert links == {(v % 2, v) for v in range(2, 500) if near(v, v % 2)} and len(pairs) == len(listed)
    root = [r for *_, r in groups]
    main = lambda v: v < 2 or root[v] == root[v % 2] or (v % 2, v) in links
    alike = {(a, b) for a in range(2, 500) for b in range(a + 2, 500, 2) if root[a] != root[b] and not (main(a) and main(b)) and near(a, b)}
    assert len(alike) > 50 and all(p in pairs or p[0] in rest and p[1] in rest for p in alike)
    assert {0, 1} & rest == set() and len(pairs) < 0.1 * 2 * 250 * 249 / 2


@pytest.mark.parametrize("few", [32, 4])
def test_large_groups_of_nearly_alike_texts(spark, monkeypatch, few):
    """Most texts of the group are 0.5 to 0.8 alike; chains of small edits start at some of them."""
    monkeypatch.setattr(verified, "FEW", few)
    rng = random.Random(16)
    bases = [[f"w{g} {i}" for i in range(60)] for g in range(3)]
    texts = [edited(rng, rng.choice(bases), 1, 4) for _ in range(350)]
    for _ in range(150):
        texts.append(edited(rng, rng.choice(texts[100:]), 0, 2))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    listed, by_pivot = [], verified.by_pivot

    def counted(*args):
        out = by_pivot(*args)
        listed.append(out[1].count())
        return out

    monkeypatch.setattr(verified, "by_pivot", counted)
    want, got = near_copies_brute(df.collect()), {r["doc_id"] for r in verified.drop_near_copies(df.repartition(5)).collect()}
    assert want <= got and len(got - want) <= 0.02 * len(texts) and 50 < len(want) < 450
    assert listed and sum(listed) < 0.1 * len(texts) ** 2 / 2


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs of one link each, by how alike they are: nothing connects them but the link itself."""
    rng = random.Random(13)
    rows, share = [], {}
    for g in range(600):
        a = [f"a{rng.randrange(10**6)}" for _ in range(rng.randrange(100, 400))]
        b = list(a)
        for k in range(max(1, round(len(a) * rng.choice([0.008, 0.016, 0.0205, 0.026, 0.03])))):
            b[(k * len(a)) // max(1, round(len(a) * 0.0205)) % len(a)] = f"b{rng.randrange(10**6)}"
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        share[g] = len(x & y) / len(x | y)
        rows += [(2 * g, " ".join(a)), (2 * g + 1, " ".join(b))]
    kept = {r["doc_id"] for r in verified.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {g for g in share if 2 * g + 1 not in kept}
    assert all(2 * g in kept for g in share) and all(share[g] >= 0.8 for g in gone)
    alike = [g for g in share if share[g] >= 0.8]
    close = [g for g in alike if share[g] < 0.83]
    assert len(close) > 50 and len(set(close) & gone) >= 0.9 * len(close) and len(gone) >= 0.95 * len(alike)


def test_mixing(spark, docs, none):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 400), "en", rng.choice(["a", "b", "c", "d", None] + ["a"] * 5)) for i in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.takes(df).toPandas()
    again = mixing.takes(df.repartition(7)).toPandas()
    assert out.sort_values("id").reset_index(drop=True).equals(again.sort_values("id").reset_index(drop=True))
    out["source"] = out["source"].fillna("\U0010ffff")  # null is last
    out["taken"] = out["size"] * (out["whole"] * out["n"] + out["extra"])
    total = 1.5 * out["size"].sum()
    sizes = {k: int(g["size"].sum()) for k, g in out.groupby("source", dropna=False)}
    order = sorted(sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        unit = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * unit > 2 * sizes[s]}
        if not more:
            break
        full |= more
    for s, g in out.groupby("source", dropna=False):
        want = 2 * sizes[s] if s in full else weight[s] * unit
        assert abs(g["target"].iloc[0] - want) < 1e-6 and g["source_size"].iloc[0] == sizes[s]
        assert abs(g["taken"].sum() - want) <= 400
    assert mixing.takes(none).count() == 0 and mixing.mix(none).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.where("text is null").count() <= 4


def test_flight_keeps_sums():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 256):
        pi, size = rng.random(n), rng.integers(0, 900, n)
        out = mixing.flight(pi, size, 1)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert abs(out.sum() - pi.sum()) < 1e-6 and abs((out - pi) @ size) < 1e-3


def test_inclusion_probabilities():
    """Over many draws each document, the last two included, is taken as often as its probability says."""
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 9):
        pi, size = rng.random(n), rng.integers(0, 900, n)
        runs = np.array([mixing.landing(mixing.flight(pi, size, seed), size, seed) for seed in range(4000)])
        assert set(np.unique(runs)) <= {0.0, 1.0}
        assert np.abs(runs.mean(0) - pi).max() < 5 * np.sqrt(0.25 / 4000)


def test_secrets(spark, docs, none):
    assert secrets.as_string(secrets.spans("é Token = 'abc_def9' AKIA" + "A" * 16 + " " + "0a" * 12)) == "assign:2:19,access:21:41,hex:42:66"
    assert not secrets.spans("ſecret=abcdefg token=abc AKIA123")
    assert secrets.as_string(secrets.spans("secret=token: abcdef")) == ""
    ledger = secrets.scan_unseen(docs)
    ledger = common.cut(ledger)
    assert ledger.count() == 6  # distinct texts, null and empty being one
    assert secrets.scan_unseen(docs, ledger).count() == 0
    assert secrets.scan_unseen(docs, ledger, rules="rules-2").count() == 6
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("api_key: zzzzzzzz")))
    assert [r["spans"] for r in secrets.scan_unseen(more, ledger).collect()] == ["assign:0:17"]
    found = secrets.findings(docs, ledger)
    assert found.count() == len(DOCS) and found.where("n_assign > 0").count() == 1
    assert secrets.findings(none, secrets.scan_unseen(none)).count() == 0


def base_spans(text):
    """The contract's three kinds, from its words."""
    out = []
    for kind, m in enumerate((re.finditer(p, text, re.ASCII) for p in (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+"))):
        out += [(x.start(), kind, x.end()) for x in m if (len(x[1]) >= 6 if kind == 0 else len(x[0]) >= (20, 24)[kind - 1])]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_of_the_table(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = secrets.op3_secret_scan(spark, d).collect()
    assert {r["doc_id"]: r["base_sha256"] for r in got} == {i: hashlib.sha256(base_spans(t).encode()).hexdigest() for i, t in texts.items()}
    assert len(got) == len(texts) and sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got) > 0


def test_hard_secrets():
    rng = random.Random(19)
    for _ in range(300):
        t = "".join(rng.choice(["token", "=", " ", '"', "SECRET", ": ", "AKIA", "ABCD1234EFGH5678", "0a1b2c3d", "deadbeef", "é", "x", "api_key", "password", "\n", "KEY", "Passwd'"]) for _ in range(40))
        assert secrets.as_string([x for x in secrets.spans(t) if x[1] < 3]) == base_spans(t)
    for t in ("a" * 300_000, "token=" * 50_000, "AKIA" * 60_000, ". " * 100_000):
        assert secrets.as_string([x for x in secrets.spans(t) if x[1] < 3]) == base_spans(t)


def test_ledger_over_versions(spark, tmp_path):
    """Two versions of paths arrive one after the other: the second scan looks at new blobs only."""
    folder = str(tmp_path / "ledger")
    first = spark.createDataFrame([("a", 1, "token=abcdef"), ("b", 1, "plain"), ("c", 1, "plain"), (None, 1, None)], "path string, version int, text string")
    second = spark.createDataFrame([("a", 2, "clean now"), ("b", 2, "plain"), ("c", 2, "secret: zzzzzz99"), ("d", 2, "")], "path string, version int, text string")
    assert secrets.scan(first, folder).where("n_assign > 0").count() == 1
    assert spark.read.parquet(folder).count() == 3
    found = common.cut(secrets.scan(first.unionAll(second), folder))
    assert spark.read.parquet(folder).count() == 5 and found.count() == 8
    got = {r["path"]: tuple(r)[1:] for r in secrets.exposure(found, "path", "version").collect()}
    assert got == {"a": (2, 1, 1, 1, False), "b": (2, 0, None, None, False), "c": (2, 1, 2, 2, True), "d": (1, 0, None, None, False), None: (1, 0, None, None, False)}
    secrets.scan(first, folder, rules="rules-2")
    assert spark.read.parquet(folder).groupBy("rules").count().collect().__len__() == 2 and secrets.scan(second, folder).count() == 4


def test_toxicity(spark, docs, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ba", "do", "lin", "mer", "tos"]) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(900):
        t = [word() for _ in range(40)]
        if bad := rng.random() < 0.3:
            t[rng.randrange(40)] = "grumpkin"
        rows.append((i, " ".join(t), "en", "s"))
        labels.append((i, int(bad)))
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    out = toxicity.score(df, model).join(lab, "doc_id").where(toxicity.held_out("doc_id")).toPandas()
    assert ((out["score"] >= 0.5) == (out["toxic"] == 1)).mean() > 0.97
    scorer = toxicity.Scorer(model)
    for disguise in ("a g r u m p k i n", "b a g r u m p k i n", "d o  g r u m p k i n", "grum-pkin", "grum.pkin", "gr**pkin", "grumpkin***", "grumpk1n", "gr*mpkin", "g r u m p k i n", "gruuuumpkin", "g.r.u.m.p.k.i.n", "GRUMPKIN!!!", "9rumpkin"):
        assert scorer.score("ba do " + disguise + " lin") >= 0.5, disguise
    assert scorer.score("ba do lin") < 0.5 and 0 <= scorer.score(None) == scorer.score("") < 0.5
    assert toxicity.score(docs, model).count() == len(DOCS)
    empty = toxicity.fit(none, lab.where("false"))
    assert toxicity.score(docs, empty).where("score = 0").count() == len(DOCS) and toxicity.score(none, empty).count() == 0


def test_viterbi_equals_all_paths():
    """The likeliest of all readings of a lattice, one by one."""
    import itertools

    rng = random.Random(16)
    costs = toxicity.language_model(toxicity.trigrams(iter(["the grumpkin ate a tin of bad meat and bolted"] * 5)))
    restorer = toxicity.Restorer(costs)

    def price(word, extra):
        total, a, b = extra, 26, 26
        for c in [*word, " "]:
            k = ord(c) - 97 if "a" <= c <= "z" else 26 if c == " " else 27
            total, a, b = total + costs[a, b, k], b, k
        return total

    for _ in range(150):
        token = "".join(rng.choice("abdegmt013@$!é .-") for _ in range(rng.randrange(1, 7)))
        arcs = restorer.arcs(token)
        best = min(price("".join(x for x, _ in path), sum(c for _, c in path)) for path in itertools.product(*arcs))
        got = restorer.viterbi(token)
        assert min(price(w, c) for w, c in (("".join(x for x, _ in p), sum(c for _, c in p)) for p in itertools.product(*arcs)) if w == got) <= best + 1e-9
    assert restorer.viterbi("b4d") == "bad"


def test_pieces(docs, none):
    codec = pieces.Codec(pieces.load())
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(7)
    texts = [None, "", " ", LONG, "x" * 5000, "日本" * 50, "a\n\n b\t\x00é😀  "]
    texts += ["".join(rng.choice(["ab c", "the ning er", "aaaa \n", "é日😀x \x00", "  ▁a"][i % 5]) for _ in range(200)) for i in range(60)]
    for t in texts:
        assert codec.encode(t).tolist() == lib.encode(t or "")
        if "▁" not in (t or ""):
            assert codec.decode(codec.encode(t)) == (t or "")
    long = "qzxv" * 3000
    assert list(codec.stream(long)) == lib.encode(long)[1:] or list(codec.stream("▁" + long)) == lib.encode(long)
    for alphabet in ("ab", "0123456789", "x", "日本語é😀", "aeiou.,-"):  # no space anywhere: the window moves along, paths or none converging
        long = "".join(rng.choice(alphabet) for _ in range(60_000))
        assert codec.encode(long).tolist() == lib.encode(long) and codec.decode(codec.encode(long)) == long
    out = pieces.encode_decode(docs)
    assert out.count() == len(DOCS) and out.where("not round_trip").count() == 0 and pieces.encode_decode(none).count() == 0


def test_walks_in_step_equal_the_stream():
    codec = pieces.Codec(pieces.load())
    rng = random.Random(17)
    parts = list({"".join(rng.choice(["th", "e", "▁", "ing", "é", "😀", "日", "x", "\U0010ffff"]) for _ in range(rng.randrange(1, 30))) for _ in range(3000)})
    assert [np.frombuffer(x, np.int32).tolist() for x in codec.stretches(parts)] == [list(codec.stream(p)) for p in parts]
    keys = np.array([rng.choice(list(codec.text)) << 31 | rng.choice(list(codec.text)) for _ in range(3000)])
    keys = np.unique(np.append(keys, [codec.ids[a] << 31 | codec.ids[b] for a in "abcdet" for b in ("h", "he", "t", "ing")]))
    want = [codec.merged(codec.text[k >> 31] + codec.text[k & 0x7FFFFFFF]) == [codec.text[k >> 31], codec.text[k & 0x7FFFFFFF]] for k in keys.tolist()]
    assert codec.stay(keys).tolist() == want and len(set(want)) == 2


VECTORS = "vec_id long, embedding array<double>"


def vectors(spark, n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(None, [1.0] * dim), (n + 1, None), (n + 2, [None] + [0.0] * (dim - 1)), (n + 3, [float("nan")] * dim), (n + 4, [float("inf")] * dim), (n + 5, [0.0] * dim), (n + 6, [1.0])]
    return x, spark.createDataFrame(rows + bad + rows[:3], VECTORS)


def every(n):
    return F.col("vec_id") % n == 0


def brute_top(x, ids, own, k):
    """[(rank, id, score)] of the row ``own``; ties to the smaller id."""
    s = x @ x[own]
    s[own] = -np.inf
    return [(i + 1, int(ids[b]), s[b]) for i, b in enumerate(np.lexsort((ids, -s))[: min(k, len(ids) - 1)])]


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(grid, "SHARD_ROWS", 600)
    monkeypatch.setattr(grid, "BLOCK_ROWS", 5)
    x, df = vectors(spark, 5000, 8, 1)
    got = collections.defaultdict(list)
    for r in topk.exact_top_k(df, every(500), 10).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    v = np.floor(1024 * np.vstack([x, np.zeros((1, 8)), np.ones((1, 8)), x[:3]]))  # a zero vector, one without id, three repeated
    ids = np.concatenate([np.arange(5000), [5005, grid.NO_ID], [0, 1, 2]])
    name = lambda some: [(r, None if i == grid.NO_ID else i, int(s)) for r, i, s in some]
    for q in range(500, 5000, 500):
        assert sorted(got[q]) == name(brute_top(v, ids, q, 10))
    twice = sorted([*name(brute_top(v, ids, 0, 10)), *name(brute_top(v, ids, 5002, 10))])
    assert sorted(got[0]) == twice  # both rows of id 0 ask, and find each other
    few = df.where("vec_id < 4 and vec_id > 2")
    assert topk.exact_top_k(few.unionAll(few), every(3), 10).count() == 2
    assert topk.exact_top_k(df.where("false"), every(1), 10).count() == 0 and topk.exact_top_k(df, F.lit(False), 10).count() == 0
    odd = df.limit(50).withColumns({c: F.lit("x") for c in ("rid", "v", "asks", "shard", "score", "rank", "block", "ids")})
    assert topk.exact_top_k(odd, every(1), 3).count() == 150


def test_repeated_ids_are_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0])]
    got = topk.exact_top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0, 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 3 * 1024**2), (1, 3 * 1024**2), (1, 2 * 1024**2)]


def test_exact_sums_of_large_components(spark):
    big = float(2**40)
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [big, 1.0]), (2, [big, 2.0])], VECTORS)
    assert [(r["vec_id"], r["score"]) for r in topk.exact_top_k(df, F.col("vec_id") == 0, 2).orderBy("rank").collect()] == [(1, 1024 * 1024 * 2**40), (2, 1024 * 1024 * 2**40)]


def recall(spark, df, n):
    rows = [r for r in df.where("embedding is not null").collect() if len(r["embedding"]) > 1 and all(c is not None and np.isfinite(c) for c in r["embedding"]) and any(r["embedding"])]
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([grid.NO_ID if r["vec_id"] is None else r["vec_id"] for r in rows])
    out = ann.nearest(df, every(n), 20).toPandas()
    asked, hit, want = [i for i in np.flatnonzero((ids % n == 0) & (ids != grid.NO_ID))], 0, 0
    for i in asked:
        g = out[out["query_id"] == ids[i]].sort_values("rank")
        true = brute_top(x, ids, i, 20)
        assert len(g) >= len(true) and (g["rank"].iloc[: len(true)].to_numpy()[:1] == 1).all()
        hit += len({t[1] for t in true} & set(g["vec_id"].fillna(grid.NO_ID).astype("int64")))
        want += len(true)
    scores = {(int(q), int(v)): s for q, v, s in zip(out["query_id"], out["vec_id"].fillna(-1), out["score"])}
    at = {int(v): j for j, v in enumerate(ids)}
    assert all(np.isclose(s, x[at[v]] @ x[at[q]], rtol=1e-12, atol=0) for (q, v), s in scores.items() if v >= 0 and (ids == v).sum() == 1 and (ids == q).sum() == 1)
    return hit / want


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(grid, "SHARD_ROWS", 700)
    x, df = vectors(spark, 3000, 64, 2)
    assert recall(spark, df, 100) >= 0.9
    few = df.where("vec_id between 4 and 7")
    assert ann.nearest(few, every(1), 20).count() == 12 and ann.nearest(df.where("false"), every(1), 20).count() == 0
    odd = few.withColumns({c: F.lit("x") for c in ("rid", "v", "asks", "shard", "score", "rank", "block", "ids")})
    assert ann.nearest(odd, every(1), 2).count() == 8


def test_nearest_neighbours_of_the_tables(spark):
    assert recall(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 20) >= 0.9


def test_probes_find_every_code_within_the_radius():
    """Both ways of probing, against all distances; at 16,384 rows few are left to rerank."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(16384, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    model = ann.fit(x[:4096], 20, 0.95, len(x))
    c, tables = ann.indexer({64: model})(x)
    for radius in (model["radius"], 40, 20):
        far = ann.apart(c[:40, None], c[None])
        hit = ann.probed(c[:40].view(np.uint16).reshape(40, -1), tables, radius)
        assert hit[far <= radius].all()
        if radius == model["radius"]:
            assert (far <= radius).mean() < 0.05


def test_licenses(docs, none):
    out = {(r["doc_id"], r["labels"]) for r in licenses.scan(docs).collect() if r["labels"]}
    assert out == {(7, "apache,apache-2.0")}
    assert licenses.scan(docs).count() == len(DOCS) and licenses.scan(none).count() == 0


def test_similarity_join_equals_all_pairs(spark):
    rng = random.Random(8)
    templates = [("t1", "alpha beta gamma delta epsilon"), ("t2", "beta gamma zeta eta theta iota kappa"), ("t3", "one two"), ("t4", " ".join(f"w{i}" for i in range(30)))]
    vocabulary = sorted({w for _, t in templates for w in t.split()} | {"other", "more", "words"})
    rows = [(i, "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 12))) for _ in range(rng.choice([1, 4, 30])))) for i in range(200)]
    rows += [(i, "x " * (i % 7) + templates[3][1].replace(" ", ["\n", " , "][i % 2])) for i in range(1000, 1010)] + [(2000, ""), (2001, None)]
    got = {(r["key"], r["scale"], r["first"], r["label"]): round(r["containment"], 9) for r in licenses.similar_blocks(spark.createDataFrame(rows, "key long, text string"), templates, 0.6).collect()}
    want = {}
    for k, text in rows:
        w = re.findall("[a-z0-9]+", text or "")
        for label, t in templates:
            scale, s = licenses.scale_of(t), set(t.split())
            i = 0
            while i == 0 or i < len(w) - scale // 2:
                share = len(set(w[i : i + scale]) & s) / len(s)
                if share >= 0.6:
                    want[k, scale, i, label] = round(share, 9)
                i += scale // 2
    assert got == want and {k[3] for k in want} == {"t1", "t2", "t3", "t4"} and {k[1] for k in want} == {32, 128}


def test_wrapped_licenses(spark):
    """Statements and whole texts, over any lines and amid other text, give their labels."""
    rng = random.Random(18)
    rows = []
    for no, (label, text) in enumerate(licenses.TEMPLATES):
        w = text.split()
        lines = [" ".join(w[i : i + 7]) for i in range(0, len(w), 7)]
        before = " ".join(f"q{rng.randrange(99)}" for _ in range(rng.randrange(0, 300)))
        rows.append((no, label, before + "\n * " + "\n * ".join(lines).capitalize() + ".\n" + before))
    out = licenses.scan(spark.createDataFrame(rows, "no int, label string, text string")).collect()
    assert len(out) == len(rows) and all(r["label"] in r["labels"].split(",") and r["score"] >= 0.8 for r in out)


def test_pii(spark, docs, none):
    text = "bob.7@mail.example 4041894974608795 4041894974608796 10.0.0.1 999.1.1.1 +1 (988) 555-2485 123-45-6789 2024-02-29 2023-02-29"
    df = spark.createDataFrame([(1, text, "x"), (2, f"again {text} and {text}", "x")], "doc_id long, text string, n_card string")
    a, b = (r["text"] for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect())
    assert b == f"again {a} and {a}"  # equal values stay equal
    old, new = text.split(), a.split()
    assert [x == y for x, y in zip(old, new)] == [False, False, True, False, True, True, False, False, False, False, True]
    assert all(re.sub("[0-9]", "9", re.sub("[a-z]", "a", x)) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", y)) for x, y in zip(old, new) if "." not in x)
    digits = [int(d) for d in new[1]]
    assert sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0
    assert pii.pseudonymise(df, "other").first()["text"] != a
    out = pii.pseudonymise(docs, "k")
    assert out.count() == len(DOCS) and out.where("n_email = 1").count() == 1 and pii.pseudonymise(none, "k").count() == 0
    kept = pii.pseudonymise(df.withColumn("n_email", F.lit("mine")), "k", counted=False)
    assert kept.columns == ["doc_id", "text", "n_card", "n_email"] and kept.first()["n_card"] == "x"


def feistel(values, moduli, key, kind):
    """The permutation from its description."""
    half = -(-len(moduli) // 2)
    for r in range(10):
        left = r % 2 == 0
        other = values[half:] if left else values[:half]
        digest = hashlib.sha256("|".join([key, kind, str(r), ",".join(map(str, moduli)), ",".join(map(str, other))]).encode()).hexdigest()
        values = [(x + int(digest[i * 4 % 61 : i * 4 % 61 + 4], 16)) % moduli[i] if (i < half) == left else x for i, x in enumerate(values)]
    return values


def spelled(s, key, kind):
    own = [c for c in s if c.isalnum()]
    moduli = [10 if c.isdigit() else 26 for c in own]
    first = [48 if c.isdigit() else 65 if c.isupper() else 97 for c in own]
    new = iter(chr(x + f) for x, f in zip(feistel([ord(c) - f for c, f in zip(own, first)], moduli, key, kind), first))
    return "".join(next(new) if c.isalnum() else c for c in s)


def pseudonym(s, key):
    """One valid value, by kind, from the module's description."""
    import datetime

    if "@" in s:
        local, domain = s.split("@", 1)
        return spelled(local, key, "email") + "@" + domain
    digits = [int(c) for c in s if c.isdigit()]
    if re.fullmatch(r"[0-9.]+", s) and s.count(".") == 3:
        return ".".join(map(str, feistel([int(x) for x in s.split(".")], [256] * 4, key, "ip")))
    if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", s):
        area = int(s[:3])
        a, b, c = feistel([area - 1 - (area > 666), int(s[4:6]) - 1, int(s[7:]) - 1], [898, 99, 9999], key, "ssn")
        return f"{a + 1 + (a + 1 > 665):03}-{b + 1:02}-{c + 1:04}"
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)|(\d\d)/(\d\d)/(\d{4})|(\d\d)\.(\d\d)\.(\d{4})", s):
        y, mo, da = (m[1], m[2], m[3]) if m[1] else (m[6], m[4], m[5]) if m[6] else (m[9], m[8], m[7])
        first = datetime.date(1800, 1, 1)
        n = (datetime.date(int(y), int(mo), int(da)) - first).days
        a, b = feistel([n // 773, n % 773], [189, 773], key, "date")
        day = first + datetime.timedelta(a * 773 + b)
        return day.strftime("%Y-%m-%d" if m[1] else "%m/%d/%Y" if m[6] else "%d.%m.%Y")
    if len(digits) >= 13:
        new = feistel(digits[:-1], [10] * (len(digits) - 1), key, "card")
        total = sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(reversed(new)))
        new = iter([*new, -total % 10])
        return "".join(str(next(new)) if c.isdigit() else c for c in s)
    local = re.search(r"(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}$", s)[0]
    return s[: len(s) - len(local)] + spelled(local, key, "phone")


def test_pseudonyms_equal_a_plain_model(spark):
    rng = random.Random(20)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = number(15)
        total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(body)))
        c = body + str(-total % 10)
        return rng.choice([c, " ".join(c[i : i + 4] for i in range(0, 16, 4))])

    values = [f"{rng.choice(['Bob', 'a.b', 'x_9', 'Q'])}{number(2)}@Mail{number(1)}.example.org" for _ in range(12)]
    values += [card() for _ in range(12)] + [".".join(str(rng.randrange(1, 256)) for _ in range(4)) for _ in range(12)]
    values += [rng.choice(["+1 ", ""]) + f"({rng.randrange(200, 999)}) 555-{number(4)}" for _ in range(12)]
    values += [f"{rng.choice([1, 665, 667, 899, rng.randrange(1, 660)]):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10000):04}" for _ in range(12)]
    values += [rng.choice([f"{y}-{m:02}-{d:02}", f"{m:02}/{d:02}/{y}", f"{d:02}.{m:02}.{y}"]) for y, m, d in [(1800, 1, 1), (2199, 12, 31), (2024, 2, 29)] + [(rng.randrange(1800, 2200), rng.randrange(1, 13), rng.randrange(1, 29)) for _ in range(9)]]
    df = spark.createDataFrame([(i, f"so {v}, then") for i, v in enumerate(values)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, "key 1").collect()}
    assert [got[i] for i in range(len(values))] == [f"so {pseudonym(v, 'key 1')}, then" for v in values]


def test_pseudonyms_are_permutations(spark):
    """Small formats, every value: none meets another."""
    ids = spark.range(898).select(F.concat(F.lpad((F.col("id") + 1 + (F.col("id") > 664).cast("int")).cast("string"), 3, "0"), F.lit("-45-6789")).alias("s"))
    assert ids.select(pii._ssn(F.col("s"), "k").alias("p")).where("p rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'").distinct().count() == 898
    days = spark.range(146097).select(F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("s"))
    assert days.select(pii._date(F.col("s"), "k").alias("p")).distinct().count() == 146097
    ips = spark.range(65536).select(F.concat(F.lit("10.0."), F.shiftright("id", 8), F.lit("."), F.col("id").bitwiseAND(255)).alias("s"))
    assert ips.select(pii._ip(F.col("s"), "k").alias("p")).distinct().count() == 65536
    phones = spark.range(10000).select(F.concat(F.lit("(555) 555-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("s"))
    assert phones.select(pii._phone(F.col("s"), "k").alias("p")).distinct().count() == 10000
    cards = spark.range(10000).select(F.concat(F.lit("41110000000"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("0")).alias("s"))
    assert cards.select(pii._card(F.col("s"), "k").alias("p")).distinct().count() == 10000
    mails = spark.range(10000).select(F.concat(F.lit("a"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("@x.org")).alias("s"))
    assert mails.select(pii.pseudonym(F.col("s"), F.lit("email"), "k").alias("p")).distinct().count() == 10000


def test_long_odd_texts(spark):
    """One value of very many parts, or none at all in very long runs."""
    texts = ["x@" + "ab." * 20_000 + "com", "." * 200_000, "9" * 200_000, "@" * 200_000, "a." * 100_000, "1.2." * 50_000, "1-" * 100_000, "x" * 200_000, "(" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}
    assert out[0]["n_email"] == 1 and out[0]["text"].endswith("@" + "ab." * 20_000 + "com")
    assert all(out[i]["text"] == t for i, t in enumerate(texts) if i)
    assert licenses.scan(df).count() == secrets.scan(df).count() == simhash.near_groups(df).count() == len(texts)
    assert pieces.encode_decode(df).where("not round_trip").isEmpty()
    scorer = toxicity.Scorer({"lm": toxicity.language_model(np.zeros(28**3)), "words": {"bad": 1.0}, "slope": 1.0, "base": 0.0})
    assert all(0 <= scorer.score(t) <= 1 for t in [*texts, "a " * 20_000, "a.b" * 20_000, "*a" * 5000])


def removed(texts, span):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + span] for r in raws for i in range(len(r) - span + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                gone[i : i + span] = True
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats(spark, hot):
    rng = random.Random(9)
    for alphabet in ("ab", "é x", "abcdefgh"):
        pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 60))) for _ in range(12)]
        texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(80)] + [None, "", "ab" * 300]
        texts += texts[:5]
        out = repeats.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 32, hot).toPandas().sort_values("id")
        assert [(a, b, c, hashlib.sha256(k).hexdigest()) for a, b, c, k in zip(out.n_bytes, out.n_removed, out.n_spans, out.kept)] == removed(texts, 32)


def test_repeats_of_the_table(spark):
    """The query itself on all rows of a table, against every window of 400 bytes."""
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in repeats.op10_repeats(spark, d).collect()}
    want = {r["doc_id"]: x for r, x in zip(rows, removed([r["text"] for r in rows], 400))}
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want and sum(x[1] > 0 for x in want.values()) > 10


def test_repeats_hard_rows(docs, none):
    out = repeats.without_repeats(docs).toPandas()
    assert len(out) == len(DOCS) and out.loc[out["id"] == 6, "n_removed"].item() == len(LONG)
    assert repeats.without_repeats(none).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_toxic_documents_go(spark):
    """The stage on a table with labels enough to learn from."""
    import corpus_pipeline as p

    d = "/root/testdata/sf0.1"
    kept = {r["doc_id"] for r in p.toxicity_stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d).select("doc_id").collect()}
    for toxic, least, most in ((1, 0, 0.15), (0, 0.98, 1)):
        ids = {r["doc_id"] for r in spark.read.parquet(f"{d}/labels.parquet").where(F.col("toxic") == toxic).collect()}
        assert least <= len(ids & kept) / len(ids) <= most


def test_pipeline(spark, docs):
    """Each stage on what the one before it kept, against what brute force says of it."""
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    left = spark.read.parquet(f"{d}/documents.parquet")
    columns = left.columns
    for name, stage in p.STAGES:
        before, left = left.collect(), common.cut(stage(spark, left, d))
        rows = left.collect()
        if name != "encoding":
            assert left.columns == columns
        old, new = {r["doc_id"]: r for r in before}, {r["doc_id"]: r for r in rows}
        if name == "toxicity":
            toxic = {r["doc_id"] for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").collect()}
            clean = {r["doc_id"] for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic = 0").collect()}
            assert len(clean & set(new)) >= 0.95 * len(clean & set(old)) and not set(new) - set(old) and len(toxic & set(new)) <= len(toxic & set(old))
        elif name == "near_copies":
            assert set(new) == near_copies_brute(before)
        elif name == "pseudonyms":
            assert set(new) == set(old) and all(len(words_of(new[i]["text"])) == len(words_of(r["text"])) for i, r in old.items())
            assert any(new[i]["text"] != r["text"] for i, r in old.items())
        elif name == "mixing":
            assert set(new) <= set(old) and all(new[i]["text"] == old[i]["text"] for i in new)
            total = sum(len(words_of(r["text"])) for r in before)
            assert abs(sum(len(words_of(r["text"])) for r in rows) - 1.5 * total) < 0.02 * total
            assert max(collections.Counter(r["doc_id"] for r in rows).values()) <= 2
        else:
            lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
            assert len(rows) == len(before) and all(r["round_trip"] and r["ids"] == lib.encode(r["text"] or "") for r in rows)
    hard = docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("score"), F.lit("m").alias("n_email"), F.lit(0).alias("_score"))
    kept = hard
    for name, stage in p.STAGES:
        kept = common.cut(stage(spark, kept, d))
        assert name == "encoding" or kept.columns == hard.columns
    assert kept.where("_score <> 0 or score <> 1 or n_email <> 'm'").isEmpty() and not kept.where("text like 'Licensed%'").isEmpty()
    none = hard.where("false")
    for _, stage in p.STAGES:
        none = common.cut(stage(spark, none, d))
    assert none.isEmpty()


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
