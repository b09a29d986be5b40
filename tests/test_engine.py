"""Properties of the operators that plain SQL does not express."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.functions import scalar
from lithic.operators import chunking, collection, delta, diff, kv, similarity, stages, store
from lithic.options import Options, from_json

SMALL = Options(min_chunk=64, avg_chunk=128, max_chunk=512)


def byte_loop(b: bytes, o: Options) -> list[int]:
    """Content-defined cuts byte by byte."""
    w, ends, start, h = o.rolling_window, [], 0, 0
    for i in range(len(b)):
        n = i + 1 - start
        h = (h * 257 + b[i]) % 65536
        if n > w:
            h = (h - b[i - w] * pow(257, w, 65536)) % 65536
        if (n >= max(o.min_chunk, w + 1) and h & ((1 << o.mask_bits) - 1) == 0) or n == o.max_chunk:
            ends.append(i + 1)
            start, h = i + 1, 0
    return ends + [len(b)] * (start < len(b))


@pytest.mark.parametrize("seed", range(6))
def test_cuts_equal_the_byte_loop(seed):
    rng = random.Random(seed)
    b = bytes(rng.choices(range(256) if seed % 2 else b"ab \n", k=rng.randint(0, 9000)))
    assert chunking.cut_points(np.frombuffer(b, np.uint8), SMALL) == byte_loop(b, SMALL)


def test_options():
    assert from_json('{"min_chunk": 1, "avg_chunk": 2, "max_chunk": 3, "other": 1}').mask_bits == 1
    with pytest.raises(ValueError):
        Options(min_chunk=9, avg_chunk=8, max_chunk=10)
    with pytest.raises(ValueError):
        Options(chunking="fixed")


def test_delta_contract():
    rng = random.Random(1)
    for _ in range(200):
        base = bytes(rng.choices(range(4), k=rng.randint(0, 300)))
        target = base[: rng.randint(0, 300)] + bytes(rng.choices(range(256), k=rng.randint(0, 40))) + base[rng.randint(0, 300) :]
        d = delta.create(base, target)
        assert delta.apply(base, d) == target
        assert delta.output_size(d) == len(target) == sum(delta.analyze(d))


def cursor_model(old, new, least, most):
    """The rule, word for word: two cursors, a window, a gap that stays open."""
    i = j = 0
    regions, gap, w = [], None, least
    while i < len(old) and j < len(new):
        if old[i] == new[j]:
            if gap is not None:
                regions.append((*gap, i, j))
                gap = None
            i, j, w = i + 1, j + 1, least
            continue
        si, sj = i, j
        hit = next(((si + k, sj + d) for d in range(w) for k in range(w) if sj + d < len(new) and si + k < len(old) and old[si + k] == new[sj + d]), None)
        if hit:
            i, j = hit
            regions.append((*(gap or (si, sj)), i, j))
            gap, w = None, least
        else:
            gap = gap or (si, sj)
            j = min(len(new), sj + w)
            i, w = min(len(old), j), most
    if gap is None and (i < len(old) or j < len(new)):
        gap = (i, j)
    if gap is not None:
        regions.append((*gap, len(old), len(new)))
    out = []
    for si, sj, i, j in regions:
        n_old, n_new = max(0, i - si), j - sj
        if n_old or n_new:
            out.append((si, si + n_old - 1, sj, j - 1, "modify" if n_old and n_new else "insert" if n_new else "delete"))
    return out


def test_sliding_regions_equal_the_cursor_model():
    rng = random.Random(2)
    back = 0
    for case in range(400):
        old = [str(rng.randint(0, 30)) for _ in range(rng.randint(0, 60))]
        new = list(old)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(new))
            new[at : at + rng.randint(0, 9)] = [f"n{rng.randint(0, 99)}" for _ in range(rng.randint(0, 12))]
        if case % 5 == 0:
            old = [f"o{i}" for i in range(rng.randint(0, 25))] + old  # the old cursor is ahead: it has to go back
        got = diff.sliding_regions(old, new, 3, 5)
        assert got == cursor_model(old, new, 3, 5)
        back += any(b < a for a, b, _, _, _ in got)
        covered = {j for _, _, c, e, _ in got for j in range(c, e + 1)}
        assert all(new[j] in old for j in set(range(len(new))) - covered)
    assert back and diff.sliding_regions(["a", "b"], ["a", "b"], 48, 256) == []


def test_features_survive_small_edits():
    rng = np.random.default_rng(3)
    kept = 0
    for _ in range(40):
        b = rng.integers(0, 256, 2048).astype(np.uint8)
        c = b.copy()
        c[rng.integers(0, 2048)] ^= 1
        assert similarity.ntransform(b, 8) == similarity.ntransform(b.copy(), 8)
        kept += np.mean(np.array(similarity.ntransform(b, 8)) == similarity.ntransform(c, 8)) > 0.5
        assert np.mean(np.array(similarity.finesse(b, 16)) == similarity.finesse(c, 16)) >= 15 / 16
    assert kept >= 36


def test_window_hashes_and_features_by_definition():
    """Each window's hash in whole numbers, then maxima by position and by part."""
    rng = random.Random(8)
    for n in (0, 1, 47, 48, 49, 300):
        b = bytes(rng.choices(range(256), k=n))
        w = min(48, n)
        want = [0]
        if w:
            want = []
            for i in range(n - w + 1):
                h = sum((c + 1) * pow(0x01000193, k, 2**64) for k, c in enumerate(b[i : i + w])) % 2**64
                h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
                want.append(h >> 32)
        a = np.frombuffer(b, np.uint8)
        assert similarity.window_hashes(a).tolist() == want
        m, c = similarity._MULTIPLY.tolist(), similarity._ADD.tolist()
        assert similarity.ntransform(a, 4) == [max((m[i] * h + c[i]) % 2**32 for h in want) for i in range(4)]
        assert similarity.finesse(a, 4) == [int(similarity.window_hashes(a[n * i // 4 : n * (i + 1) // 4]).max()) for i in range(4)]


def test_super_features_of_the_table(spark):
    """The queries' rows against features and hashes made one by one."""
    import hashlib

    from lithic.plans import queries as q

    d = "/root/testdata/sf0.001"
    data = {r.fp: np.frombuffer(r.data, np.uint8) for r in q.fixed(spark, d, True).collect()}
    for method in similarity.EXTRACTORS:
        rows = q.QUERIES[f"{method}_features"](spark, d).collect()
        assert {r.fp: r.features for r in rows} == {fp: similarity.EXTRACTORS[method](b, 16) for fp, b in data.items()}
    want = {}
    for fp, b in data.items():
        f = similarity.finesse(b, 16)
        ranked = [sorted(f[g : g + 4]) for g in range(0, 16, 4)]
        want[fp] = [hashlib.md5(",".join(str(g[r]) for g in ranked).encode()).hexdigest() for r in range(4)]
    got = q.QUERIES["super_features"](spark, d).collect()
    assert {r.fp: r.sf for r in got} == want and len(got) == len(data)


def test_delta_reports_of_the_table(spark):
    """Totals from deltas made one by one, of the pairs that plain code finds."""
    from lithic.plans import queries as q

    d = "/root/testdata/sf0.001"
    old, new = ({(r.file_id, r.chunk_id): r for r in f(spark, d, True).collect()} for f in (q.fixed, q.fixed2))
    data = {r.fp: bytes(r.data) for r in [*old.values(), *new.values()]}
    first = {}
    for key in sorted(new):
        first.setdefault(new[key].fp, key)
    pairs = set()
    for r in diff.anchor_regions(q.fixed(spark, d), q.fixed2(spark, d)).where("kind = 'modify'").collect():
        n_old, n_new = r.old_end - r.old_start + 1, r.new_end - r.new_start + 1
        ends = [(r.old_start, r.new_start), (r.old_end, r.new_end)] if min(n_old, n_new) >= 2 else [(r.old_start, r.new_start)] if n_old == n_new == 1 else []
        for o, n in ends:
            a, b = old[r.file_id, o].fp, new[r.file_id, n].fp
            if first[b] == (r.file_id, n) and a != b and data[a][:-2] != data[b][:-2]:
                pairs.add((a, b))

    def report(pairs):
        made = [(len(delta.create(data[a], data[b])) + 32, len(data[b])) for a, b in pairs]
        ok = [(x, n) for x, n in made if x < n and x < 16384]
        return (len(made), sum(n for _, n in made), sum(min(x, n) if (x, n) in ok else n for x, n in made), len(ok), sum(n for _, n in ok), sum(x for x, _ in ok))

    assert pairs and tuple(q.QUERIES["delta_report_positional"](spark, d).first()) == report(pairs)
    groups = q.similarity.groups(q.similarity.sketches(q.chunking.chunks(q.files(spark, d), q.DOCUMENTS)), 4).collect()
    bases = {r.base_fp for r in groups}
    base_of = {}
    for r in groups:
        if r.member_fp not in bases:
            base_of[r.member_fp] = min(r.base_fp, base_of.get(r.member_fp, r.base_fp))
    data |= {r.fp: bytes(r.data) for r in q.chunking.chunks(q.files(spark, d), q.DOCUMENTS).collect()}
    assert base_of and tuple(q.QUERIES["delta_report_groups"](spark, d).first()) == report({(a, b) for b, a in base_of.items()})
    assert q.version_deltas(spark, d).count() == len(pairs)


def test_pairs_equal_but_for_their_ends(spark):
    data = spark.createDataFrame([("a", bytearray(b"x" * 90 + b"12")), ("b", bytearray(b"x" * 90 + b"34")), ("c", bytearray(b"y" + b"x" * 91))], "fp string, data binary")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a")], "base_fp string, new_fp string")
    assert [r.new_fp for r in delta.encode_pairs(pairs, data, tail=2).collect()] == ["c"]
    assert delta.encode_pairs(pairs, data).count() == 2
    row = delta.encode_pairs(pairs, data, tail=2).select(delta.analyze_udf(F.col("delta")).alias("a"), "new_len").first()
    assert row.a.n_copy + row.a.n_insert == row.new_len


def test_super_features(spark):
    df = spark.range(1).select(F.array(*[F.lit(x) for x in range(16)]).alias("f"))
    for method in similarity.EXTRACTORS:
        sf = df.select(similarity.super_features(F.col("f"), 4, method).alias("s")).first()["s"]
        assert len(sf) == len(set(sf)) == 4
    row = df.select(scalar.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("o")).first()
    assert row["o"] == 0.5


def test_segments_close_by_rule():
    fps = ["3f" + "0" * 62, "00" * 32, "7f" + "1" * 62, "00" * 32]
    assert chunking.group_ids(fps, [10, 10, 10, 10], (15, 20, 100), 64)[0] == [0, 0, 0, 1]
    assert chunking.group_ids(["00" * 32] * 3, [60, 60, 60], (10, 20, 50), 64)[0] == [0, 0, 1]


def test_restore_after_deltas_and_compaction(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abc\x00 ", k=rng.randint(0, 3000))) for _ in range(6)] + ["", None]
    df = spark.createDataFrame([(i, 0, bytearray((t or "").encode())) for i, t in enumerate(texts)], "file_id long, version int, content binary")
    c = chunking.chunks(df, SMALL)
    assert {(r.file_id, bytes(r.content)) for r in store.restore(c.drop("data"), store.payload_store(c)).collect()} == {(i, t.encode()) for i, t in enumerate(texts) if t}
    part = store.restore(c.drop("data"), store.payload_store(c), 1, 2).collect()
    assert all(r.complete for r in part)
    packed = store.pack_exact(c, 1000, 3)
    sizes = store.live_sizes(packed).collect()
    assert all(r.live_bytes <= 1000 for r in sizes)
    again = store.compact(packed, c, 600, 1000)
    assert again.count() == packed.count() == c.select("fp").distinct().count()


def test_restore_follows_chains_to_their_end(spark):
    rng = random.Random(6)
    texts = [rng.randbytes(300)]
    for i in range(11):
        texts.append(texts[-1][:100] + b"edit %d" % i + texts[-1][100:])
    rows_ = [("0", bytearray(texts[0]), None, None)] + [(str(i), None, str(i - 1), bytearray(delta.create(texts[i - 1], texts[i]))) for i in range(1, 12)]
    rows_.append(("lost", None, "nowhere", bytearray(delta.create(b"", b"x"))))
    chain = spark.createDataFrame(rows_, "fp string, data binary, base_fp string, delta binary")
    recipes = spark.createDataFrame([(i, 0, 0, len(t), str(i)) for i, t in enumerate(texts)] + [(99, 0, 0, 1, "lost")], "file_id long, version int, chunk_id long, chunk_len long, fp string")
    got = {r.file_id: (r.complete, r.content and bytes(r.content)) for r in store.restore(recipes, chain).collect()}
    assert {i: got[i] for i in range(12)} == {i: (True, t) for i, t in enumerate(texts)}
    assert not got[99][0]


def test_key_value_against_a_model(spark):
    rng = random.Random(5)
    model, history, rows = {}, {}, []
    for seq in range(400):
        k = f"k{rng.randint(0, 40):02}"
        if rng.random() < 0.3:
            model.pop(k, None)
            rows.append((k, seq, "del", None))
        else:
            model[k] = rng.random()
            rows.append((k, seq, "put", model[k]))
        history[seq] = dict(model)
    log = spark.createDataFrame(rows[:0], "key string, seq long, op string, value double")
    made = spark.createDataFrame(rows, log.schema)
    log = kv.delete(kv.put(log, made.where("op = 'put'")), made.where("op = 'del'"))
    as_dict = lambda df: {r.key: r.value for r in df.collect()}
    assert as_dict(kv.latest(log)) == model
    assert as_dict(kv.latest(log, 150)) == history[150]
    assert [r.key for r in kv.scan(log, "k10", "k30").collect()] == sorted(k for k in model if "k10" <= k < "k30")
    assert [r.key for r in kv.scan(log, reverse=True).collect()] == sorted(model, reverse=True)
    small = kv.compact(log, 200)
    assert as_dict(kv.latest(small)) == model and as_dict(kv.latest(small, 300)) == history[300]


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_stage_goldens(spark):
    x = rows(spark, [(1,), (3,), (5,)], "x int")
    run = stages.run
    assert [(r["_id"], r["count"]) for r in run(x, [{"$bucket": {"groupBy": "$x", "boundaries": [0, 2, 6]}}, {"$sort": {"_id": 1}}]).collect()] == [(0, 1), (2, 2)]
    assert run(x, [{"$bucketAuto": {"groupBy": "$x", "buckets": 2}}]).count() == 2
    assert [len(r["foo"]) for r in run(x, [{"$facet": {"foo": [{"$limit": 2}]}}]).collect()] == [2]
    assert run(x, [{"$match": {"x": 9}}, {"$count": "n"}]).count() == 0
    assert run(rows(spark, [([1, 2, 3],), ([],)], "x array<int>"), [{"$unwind": "$x"}]).count() == 3
    assert run(rows(spark, [([1, 2, 3],), ([],)], "x array<int>"), [{"$unwind": {"path": "$x", "preserveNullAndEmptyArrays": True}}]).count() == 4
    assert run(x, [{"$sample": {"size": 2}}]).count() == 2
    g = rows(spark, [("bar", None), ("foo", "bar")], "x string, y string")
    out = {r.x: len(r.z) for r in run(g, [{"$graphLookup": {"from": "g", "startWith": "$y", "connectFromField": "y", "connectToField": "x", "as": "z"}}], {"g": g}).collect()}
    assert out == {"bar": 0, "foo": 1}
    l = rows(spark, [(0, None), (1, 0)], "x int, y int")
    assert {r.x: len(r.z) for r in run(l, [{"$lookup": {"from": "l", "localField": "x", "foreignField": "y", "as": "z"}}], {"l": l}).collect()} == {0: 1, 1: 0}
    red = rows(spark, [((1,), 1)], "x struct<secret:int>, y int")
    r = run(red, [{"$redact": {"$cond": {"if": {"$eq": ["$secret", 1]}, "then": "$$PRUNE", "else": "$$DESCEND"}}}]).first()
    assert r.x is None and r.y == 1
    tables = {}
    assert run(x, [{"$out": "t"}], tables).count() == 0 and tables["t"].count() == 3
    with pytest.raises(ValueError):
        run(x, [{"$out": "t"}, {"$limit": 1}])
    assert run(rows(spark, [("foo",)], "x string").where(stages.condition({"x": "FOO"}, "UTF8_LCASE")), []).count() == 1


def test_writes(spark):
    df = rows(spark, [(1, "a"), (2, "b"), (3, None)], "k int, v string")
    got = lambda d: sorted((r.k, r.v) for r in d.collect())
    assert got(collection.update_one(df, {"k": {"$gt": 1}}, {"v": "z"}, "k").where("v is not null")) == [(1, "a"), (2, "z")]
    assert got(collection.delete_one(df, {}, "k").where("v is not null")) == [(2, "b")]
    assert got(collection.delete_many(df, {"v": "a"}).where("v is not null")) == [(2, "b")]
    assert got(collection.replace(df, rows(spark, [(2, "n"), (9, "m")], "k int, v string"), "k", upsert=False).where("v is not null")) == [(1, "a"), (2, "n")]
    assert collection.distinct(rows(spark, [([1, 1, 2],)], "x array<int>"), "x").count() == 2
    with pytest.raises(Exception, match="validator"):
        collection.validated(df, {"v": {"$exists": True}}).collect()


def test_envelope(spark):
    k = F.lit(b"0" * 32)
    df = spark.range(1).select(scalar.envelope(F.lit(b"data\x00"), F.lit(b"1" * 32), k).alias("e"))
    assert bytes(df.select(scalar.open_envelope(F.col("e"), k).alias("d")).first()["d"]) == b"data\x00"


def test_cfb_and_crc_vectors(spark):
    key = bytes.fromhex("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4")
    plain = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    want = bytes.fromhex("dc7e84bfda79164b7ecd8486985d386039ffed143b28b1c832113c6331e5407b")
    iv = bytes(range(16))
    df = spark.createDataFrame([(bytearray(plain[:n]),) for n in (32, 16, 21, 0)], "p binary")
    for r in df.select("p", scalar.encrypt_cfb(F.col("p"), F.lit(key), iv).alias("c")).withColumn("q", scalar.decrypt_cfb(F.col("c"), F.lit(key), iv)).collect():
        assert bytes(r.c) == want[: len(r.p)] and r.q == r.p
    assert scalar.crc32c_all([b"", b"123456789", bytes(32)]).tolist() == [0, 0xE3069283, 0x8A9136AA]
    assert spark.range(1).select(scalar.masked_crc(F.lit(0xE3069283)).alias("m")).first().m == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_hash_and_varint_vectors(spark):
    """Published values of the 32-bit hash, and numbers at the edges of their lengths."""
    for data, want in ((b"", 0xBC9F1D34), (b"\x62", 0xEF1345C4), (b"\xc3\x97", 0x5B663814), (b"\xe2\x99\xa5", 0x323C078F), (b"\xe1\x80\xb9\x32", 0xED21633A)):
        assert scalar.hash32_of(data, 0xBC9F1D34) == want
    numbers = [0, 1, 127, 128, 255, 300, 16383, 16384, 2**31, 2**32 - 1, 2**62]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", scalar.varint(F.col("n")).alias("v"))
    rows_ = df.select("n", "v", scalar.from_varint(F.col("v")).alias("back")).collect()
    assert all(r.back == r.n and len(r.v) == max(1, -(-r.n.bit_length() // 7)) for r in rows_)
    assert {r.n: bytes(r.v) for r in rows_}[300] == b"\xac\x02"


def test_blocks_give_the_chunks_of_the_whole(spark):
    rng = random.Random(7)
    whole = {f"f{i}": bytes(rng.choices(b"abcd \n", k=n)) for i, n in enumerate((0, 1, 63, 700, 5000, 30_000))}
    blocks = [(name, 0, k, bytearray(b[at : at + 997])) for name, b in whole.items() for k, at in enumerate(range(0, len(b) or 1, 997))]
    got = chunking.block_chunks(spark.createDataFrame(blocks, "file_id string, version int, block_no int, content binary"), SMALL)
    want = chunking.chunks(spark.createDataFrame([(n, 0, bytearray(b)) for n, b in whole.items()], "file_id string, version int, content binary"), SMALL)
    key = lambda df: sorted(tuple(r) for r in df.select("file_id", "chunk_id", "byte_off", "chunk_len", "fp").collect())
    assert key(got) == key(want) and len(key(got)) > 100


def test_store_of_files(spark, tmp_path):
    """Files on disk, three versions, a broken run, changes, deltas and restores."""
    from lithic.operators import backup
    from lithic.sources import files as src

    rng = random.Random(9)
    here = tmp_path / "in"
    here.mkdir()
    texts = {f"f{i}": bytes(rng.choices(b"abc \n", k=rng.randint(200, 6000))) for i in range(4)}
    kept = backup.Store(spark, str(tmp_path / "store"), SMALL)
    seen = []
    for version in range(3):
        if version:
            texts = {n: b[:100] + (rng.randbytes(9) + b[100:] if version == 1 else bytes([b[100] ^ 1]) + b[101:]) for n, b in texts.items()}
        for n, b in texts.items():
            (here / n).write_bytes(b)
        report = {r.file_id: r for r in kept.ingest(src.binary_files(spark, str(here))).collect()}
        assert len(report) == 4 and all(r.version == version and r.file_size > 0 for r in report.values())
        assert version == 0 or all(0 < r.new_bytes < r.file_size for r in report.values())
        seen.append(sorted(texts.values()))
        if version == 1:  # a run that broke off before its heads
            kept.append("recipes", kept.version().withColumn("batch", F.lit("broken")))
    assert {(r.next_version, r.previous_version) for r in kept.versions().collect()} == {(3, 2)}
    for back in range(3):
        assert sorted(bytes(r.content) for r in kept.restore(back).collect()) == seen[2 - back]
    parts = kept.restore_parts(part=512).collect()
    assert len(parts) > 12 and all(r.complete and len(r.content) < 1024 for r in parts)
    names = {r.file_id for r in parts}
    assert sorted(b"".join(bytes(r.content) for r in sorted((r for r in parts if r.file_id == n), key=lambda r: r.part_no)) for n in names) == seen[2]
    assert kept.changes().count() >= 4 and kept.changes("window").count() >= 4
    assert kept.save_deltas().first().accepted_pairs > 0
    groups = kept.save_features()
    assert groups.count() > 0 and kept.table("features").count() == kept.counts().count()
    kept.save_features()
    assert kept.table("features").count() == kept.counts().count()  # none twice
    assert kept.save_similar(groups).first().pairs > 0
    rows_ = kept.restore(deltas=True).collect()
    assert all(r.complete for r in rows_) and sorted(bytes(r.content) for r in rows_) == seen[2]
    assert kept.delta_containers().count() > 0 and kept.containers().count() == kept.counts().count()
    gone = kept.table("heads").where("version = 0").select("file_id", "version")
    assert 0 < kept.compacted(gone).count() < kept.containers().count()
    lines = tmp_path / "trace"
    lines.write_text("\n".join(["aa:bb:cc:dd:ee:ff:" + "x" * k for k in range(3)] + ["short"]))
    assert [r.fp for r in src.trace(spark, str(lines)).collect()] == ["aa:bb:cc:dd:ee:ff:"] * 3


def test_collections_in_files(spark, tmp_path):
    from lithic.sources.database import Collections

    db = Collections(spark, str(tmp_path / "db"))
    df = rows(spark, [(1, "a"), (2, "b")], "k int, v string")
    db.create("one", df, {"k": {"$exists": True}})
    with pytest.raises(ValueError):
        db.create("one", df)
    with pytest.raises(Exception, match="validator"):
        db["one"] = rows(spark, [(None, "x")], "k int, v string")
    assert db["one"].count() == 2 and list(db) == ["one"] and "two" not in db and len(db) == 1
    db["one"] = collection.insert(db["one"], rows(spark, [(3, "c")], "k int, v string"))  # reads what it replaces
    stages.run(db["one"], [{"$match": {"k": {"$gt": 1}}}, {"$out": "two"}], db)
    db.rename("two", "three")
    assert sorted(db) == ["one", "three"] and db["three"].count() == 2
    assert db.views() == ["one", "three"] and spark.sql("SELECT count(*) AS n FROM three").first().n == 2
    del db["one"]
    assert list(db) == ["three"]
    with pytest.raises(KeyError):
        db["one"]


def test_store_options(spark, tmp_path):
    path = str(tmp_path / "kv")
    with pytest.raises(ValueError):
        kv.open_store(spark, path, create_if_missing=False)
    assert kv.open_store(spark, path).count() == 0
    with pytest.raises(ValueError):
        kv.open_store(spark, path, error_if_exists=True)
    log = rows(spark, [(f"k{i:03}", i, "put", str(i)) for i in range(500)], "key string, seq long, op string, value string")
    kv.write_sorted(log, path, 5)
    (tmp_path / "kv" / "part-broken.parquet").write_bytes(b"PAR1 no table PAR1")
    with pytest.raises(Exception):
        kv.open_store(spark, path).count()
    fixed = kv.repair(spark, path, str(tmp_path / "fixed"), 3)
    assert kv.get(fixed, "k123").first().value == "123" and fixed.count() == 500
    assert kv.destroy(spark, path) and not (tmp_path / "kv").exists()


def test_compaction_under_several_snapshots(spark):
    rng = random.Random(10)
    data = [(f"k{rng.randint(0, 9)}", i, "del" if rng.random() < 0.3 else "put", i) for i in range(300)]
    log = rows(spark, data, "key string, seq long, op string, value long")
    marks = [50, 51, 200]
    small = kv.compact(log, marks)
    for at in [*marks, 250, 299]:
        same = lambda df: {r.key: r.value for r in kv.latest(df, at).collect()}  # noqa: B023, E731
        assert same(small) == same(log)
    assert small.count() < 100 + 99 and kv.compact(log).where("op = 'del'").isEmpty()


def test_streams_go_on(spark, tmp_path):
    """Two batches of one ingest: the second holds what the first has, and more."""
    from lithic.streaming import ingest as streams

    schema = "fp string, chunk_len int"
    for part, names in enumerate((["a", "b", "a"], ["b", "c", "c"])):
        rows(spark, [(n, len(n)) for n in names], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = streams.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "job"))
        assert sorted(r.fp for r in out.collect()) == ["a", "b", "c"][: 2 + part]


def test_redact_goes_into_arrays(spark):
    df = rows(spark, [([(1, "x"), (0, "y")],)], "a array<struct<secret:int,v:string>>")
    out = stages.run(df, [{"$redact": {"$cond": {"if": {"$eq": ["$secret", 1]}, "then": "$$PRUNE", "else": "$$DESCEND"}}}]).first()
    assert [x.v for x in out.a] == ["y"]


def test_geo_near_on_the_sphere(spark):
    df = rows(spark, [("far", [0.0, 90.0]), ("near", [1.0, 0.0])], "n string, at array<double>")
    out = stages.run(df, [{"$geoNear": {"key": "$at", "near": [0.0, 0.0], "distanceField": "m", "spherical": True}}]).collect()
    assert [r.n for r in out] == ["near", "far"] and abs(out[1].m - 6378100 * np.pi / 2) < 1 and abs(out[0].m - 6378100 * np.pi / 180) < 1
    assert stages.run(df, [{"$geoNear": {"key": "$at", "near": [0.0, 0.0], "distanceField": "m", "spherical": True, "maxDistance": 1e6}}]).count() == 1


def test_find_options(spark):
    df = rows(spark, [(1, "b"), (2, "A"), (3, "a")], "k int, v string")
    assert [r.k for r in collection.find(df, sort={"v": 1, "k": 1}, collation="UTF8_LCASE").collect()] == [2, 3, 1]
    assert collection.find(df, {"v": "a"}, collation="UTF8_LCASE").count() == 2
    assert collection.find(df, projection=["k"], record_id=True).columns == ["k", "record_id"]
    assert collection.find_one(df, {"k": {"$gt": 1}}, {"k": -1}).first().k == 3
    before = collection.find_one_and(df, collection.delete_one(df, {"k": {"$gt": 1}}, "k"), {"k": {"$gt": 1}}, "k")
    assert [r.k for r in before.collect()] == [2]
    up = collection.update_one(df, {"k": 9, "v": "z"}, {"v": "new"}, "k", upsert=True)
    assert sorted((r.k, r.v) for r in up.collect()) == [(1, "b"), (2, "A"), (3, "a"), (9, "new")]
