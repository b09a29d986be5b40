"""Registered queries over the driver's tables, each with its SQL where there is one.

Every query runs over its whole tables. Files are documents; their second
version is ``sources.files.edited``. The SQL is DuckDB's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import backup, chunking, collection, dedup, delta, diff, joins, kv, similarity, stages, store
from ..options import DOCUMENTS, Options
from ..sources.database import Collections
from ..sources.files import edited, table, text_files, write_files
from ..streaming import ingest as streams
from .session import cut, prepare, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SIZE = 512
FIXED = Options(chunking="fixed", min_chunk=SIZE, avg_chunk=SIZE, max_chunk=SIZE)
HEX = "hex(encode(coalesce(text, '')))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            prepare(spark)
            return f(spark, d)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def files(spark: SparkSession, d: str) -> DataFrame:
    return text_files(table(spark, d, "documents"), "doc_id")


def files2(spark: SparkSession, d: str) -> DataFrame:
    return text_files(edited(table(spark, d, "documents")), "doc_id", version=1)


def fixed(spark: SparkSession, d: str, payload: bool = False) -> DataFrame:
    return chunking.chunks(files(spark, d), FIXED, payload)


def fixed2(spark: SparkSession, d: str, payload: bool = False) -> DataFrame:
    return chunking.chunks(files2(spark, d), FIXED, payload)


EDITED = "CASE doc_id % 3 WHEN 0 THEN regexp_replace(coalesce(text, ''), '^[^\\n]*\\n?', '') WHEN 1 THEN replace(coalesce(text, ''), 'the ', 'THE ') ELSE coalesce(text, '') || chr(10) || 'An added line.' END"


def chunks_sql(name: str = "c", text: str = "coalesce(text, '')", size: int = SIZE) -> str:
    """CTEs: fixed-size chunks of every document."""
    return f"""{name}_f AS (SELECT doc_id AS file_id, hex(encode({text})) AS h FROM documents),
{name}_i AS (SELECT file_id, h, unnest(range(CAST(ceil(length(h) / {2.0 * size}) AS BIGINT))) AS i FROM {name}_f),
{name} AS (SELECT file_id, i::INTEGER AS chunk_id, i * {size} AS byte_off, (least({2 * size}, length(h) - i * {2 * size}) / 2)::INTEGER AS chunk_len,
  sha256(unhex(substr(h, i * {2 * size} + 1, {2 * size}))) AS fp FROM {name}_i)"""


ONE = f"WITH {chunks_sql()}"
TWO = f"WITH {chunks_sql('a')}, {chunks_sql('b', EDITED)}"
FLAGGED = ONE + ", u AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY file_id, chunk_id) = 1 AS is_unique FROM c)"


@query("fixed_chunk_dedup", FLAGGED + """
SELECT count(*)::BIGINT AS total_chunks, sum(is_unique::INT)::BIGINT AS unique_chunks, sum(chunk_len)::BIGINT AS total_bytes,
  sum(CASE WHEN is_unique THEN chunk_len ELSE 0 END)::BIGINT AS unique_bytes,
  round(sum(chunk_len) / sum(CASE WHEN is_unique THEN chunk_len ELSE 0 END), 6) AS dedup_ratio FROM u""")
def _(spark, d):
    return dedup.report(fixed(spark, d))


@query("fixed_chunks", ONE + " SELECT file_id, chunk_id, byte_off::BIGINT AS byte_off, chunk_len, fp FROM c")
def _(spark, d):
    return fixed(spark, d).drop("version")


def cdc_sql(name: str = "c", text: str = "coalesce(text, '')") -> str:
    """CTEs (recursive): content-defined chunks of every document under ``DOCUMENTS``."""
    return f"""{name}_d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode({text})) AS h, octet_length(encode({text})) AS n FROM documents),
{name}_b AS (SELECT r, i, (instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1 AS v
      FROM (SELECT r, unnest(range(n)) AS i, unnest(regexp_extract_all(h, '..')) AS x FROM {name}_d)),
{name}_s AS (SELECT r, i + 1 AS e, sum(v) OVER w AS s1, sum(v * i) OVER w AS si, count(*) OVER w AS k
      FROM {name}_b WINDOW w AS (PARTITION BY r ORDER BY i ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)),
{name}_cand AS MATERIALIZED (SELECT r, list(e ORDER BY e) AS es FROM {name}_s WHERE k = 48 AND ((s1 + 256 * ((e - 1) * s1 - si))::BIGINT & 511) = 0 GROUP BY r),
{name}_x AS (SELECT r, doc_id, n, coalesce(es, []) AS es, 0::BIGINT AS st, 0::BIGINT AS en, -1 AS id FROM {name}_d LEFT JOIN {name}_cand USING (r) WHERE n > 0
      UNION ALL
      SELECT r, doc_id, n, es, en, least(n, en + 2048, coalesce(list_min(list_filter(es, lambda e: e >= {name}_x.en + 128)), n)), id + 1 FROM {name}_x WHERE en < n),
{name} AS MATERIALIZED (SELECT doc_id AS file_id, id::INTEGER AS chunk_id, st AS byte_off, (en - st)::INTEGER AS chunk_len, sha256(unhex(substr(h, 2 * st + 1, 2 * (en - st)))) AS fp
      FROM {name}_x JOIN {name}_d USING (r, doc_id) WHERE id >= 0)"""


CDC = f"WITH RECURSIVE {cdc_sql()}"


def level_sql(name: str, of: str, child: str, size: str, fp: str, least: int, most: int, divisor: int) -> str:
    """CTEs: groups of consecutive children of each file, as ``chunking.segments`` forms them."""
    first = f"(instr('0123456789abcdef', substr({of}.{fp}, 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr({of}.{fp}, 2, 1)) - 1"
    close = lambda before: f"({before} >= {least} AND ({before} > {most} OR {first} & {divisor - 1} = {divisor - 1} OR {of}.{fp} LIKE '%303030303030303030'))"
    before = f"CASE WHEN {name}_g.closed THEN 0 ELSE {name}_g.before + {name}_g.size END"
    return f"""{name}_g AS (SELECT file_id, {child}, {fp} AS fp, {size}::BIGINT AS size, 0 AS grp, 0::BIGINT AS before, {close("0")} AS closed FROM {of} WHERE {child} = 0
  UNION ALL SELECT {of}.file_id, {of}.{child}, {of}.{fp}, {of}.{size}::BIGINT, {name}_g.grp + {name}_g.closed::INT, {before}, {close(before)}
  FROM {name}_g JOIN {of} ON {of}.file_id = {name}_g.file_id AND {of}.{child} = {name}_g.{child} + 1),
{name} AS MATERIALIZED (SELECT file_id, 0 AS version, grp AS group_id, min({child}) AS first, max({child}) AS last, sum(size)::BIGINT AS size, sha256(unhex(string_agg(fp, '' ORDER BY {child}))) AS hash FROM {name}_g GROUP BY file_id, grp)"""


def segments_sql(name: str = "seg", of: str = "c") -> str:
    return level_sql(name, of, "chunk_id", "chunk_len", "fp", DOCUMENTS.segment[0], DOCUMENTS.segment[2], 64)


@query("cdc_chunks", CDC + " SELECT file_id, chunk_id, byte_off, chunk_len FROM c")
def _(spark, d):
    return chunking.chunks(files(spark, d), DOCUMENTS, payload=False).select("file_id", "chunk_id", "byte_off", "chunk_len")


@query("cdc_dedup_report", CDC + """, u AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY file_id, chunk_id) = 1 AS is_unique FROM c)
SELECT count(*)::BIGINT AS total_chunks, sum(is_unique::INT)::BIGINT AS unique_chunks, sum(chunk_len)::BIGINT AS total_bytes,
  sum(CASE WHEN is_unique THEN chunk_len ELSE 0 END)::BIGINT AS unique_bytes,
  round(sum(chunk_len) / sum(CASE WHEN is_unique THEN chunk_len ELSE 0 END), 6) AS dedup_ratio FROM u""")
def _(spark, d):
    return dedup.report(chunking.chunks(files(spark, d), DOCUMENTS, payload=False))


@query("nul_safe_fingerprint", f"""SELECT doc_id, array_to_string(list_transform(range(0, 32), lambda i: replace(substr(h, 2*i+1, 2), '00', '80')), '') AS fp
FROM (SELECT doc_id, sha256(encode(coalesce(text, ''))) AS h FROM documents)""")
def _(spark, d):
    return files(spark, d).select(F.col("file_id").alias("doc_id"), scalar.fingerprint(F.col("content"), True).alias("fp"))


@query("checksums", "SELECT doc_id, upper(hex(encode(coalesce(text, '')))) AS name FROM documents")
def _(spark, d):
    return files(spark, d).select(F.col("file_id").alias("doc_id"), scalar.hex_name(F.col("content")).alias("name"))


CRC_TABLE = str(scalar._CRC32C)


@query("crc32c", f"""WITH t AS (SELECT {CRC_TABLE}::BIGINT[] AS tab),
b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ((instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1)::BIGINT) AS v FROM documents),
k AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, v), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS crc FROM b, t)
SELECT doc_id AS file_id, crc, ((crc >> 15 | (crc << 17)) + 2726488792) & 4294967295 AS masked FROM k""")
def _(spark, d):
    crc = files(spark, d).select("file_id", scalar.crc32c(F.col("content")).alias("crc"))
    return crc.withColumn("masked", scalar.masked_crc(F.col("crc")))


@query("cfb_round_trip", "SELECT c_custkey, c_name AS opened, octet_length(encode(c_name))::INTEGER AS sealed_len FROM customer")
def _(spark, d):
    key = F.unhex(F.sha2(F.lit("key").cast("binary"), 256))
    sealed = table(spark, d, "customer").select("c_custkey", scalar.encrypt_cfb(F.encode("c_name", "UTF-8"), key).alias("s"))
    return sealed.select("c_custkey", F.decode(scalar.decrypt_cfb(F.col("s"), key), "UTF-8").alias("opened"), F.octet_length("s").alias("sealed_len"))


@query("unique_first_occurrence", FLAGGED + " SELECT file_id, chunk_id, fp, is_unique FROM u")
def _(spark, d):
    return dedup.flag_first(fixed(spark, d)).select("file_id", "chunk_id", "fp", "is_unique")


@query("ref_counts", ONE + " SELECT fp, count(*)::BIGINT AS ref_count, max(chunk_len) AS chunk_len FROM c GROUP BY fp")
def _(spark, d):
    return dedup.ref_counts(fixed(spark, d))


@query("file_totals", ONE + " SELECT file_id, sum(chunk_len)::BIGINT AS file_size, count(*)::BIGINT AS total_chunks FROM c GROUP BY file_id")
def _(spark, d):
    return dedup.file_totals(fixed(spark, d)).drop("version")


@query("dedup_ratio_rollup", FLAGGED + """
SELECT lang, source, count(*)::BIGINT AS total_chunks, sum(is_unique::INT)::BIGINT AS unique_chunks FROM u JOIN documents ON doc_id = file_id GROUP BY ROLLUP (lang, source)""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "lang", "source")
    flagged = dedup.flag_first(fixed(spark, d)).join(docs, "file_id")
    return flagged.rollup("lang", "source").agg(F.count("*").alias("total_chunks"), F.sum(F.col("is_unique").cast("long")).alias("unique_chunks"))


@query("gc_after_delete", ONE + " SELECT fp, count(*)::BIGINT AS ref_count, max(chunk_len) AS chunk_len FROM c WHERE file_id IN (SELECT doc_id FROM documents WHERE lang <> 'en') GROUP BY fp")
def _(spark, d):
    chunks = fixed(spark, d)
    gone = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("file_id"))
    left = dedup.delete_files(chunks, gone)
    kept = dedup.collect_garbage(dedup.ref_counts(chunks).select("fp", "chunk_len"), left)
    return kept.join(dedup.ref_counts(left).select("fp", "ref_count"), "fp")


@query("segment_index", f"{CDC}, {segments_sql()} SELECT file_id, version, group_id AS segment_id, first AS start_chunk_id, last AS end_chunk_id, size, hash FROM seg")
def _(spark, d):
    return chunking.chunking(files(spark, d), DOCUMENTS)["segments"]


@query("supersegment_index", f"{CDC}, {segments_sql()}, {level_sql('sup', 'seg', 'group_id', 'size', 'hash', DOCUMENTS.container_group[0], DOCUMENTS.container_group[0], 256)} SELECT file_id, version, group_id AS container_id, first AS start_segment_id, last AS end_segment_id, size, hash FROM sup")
def _(spark, d):
    return chunking.chunking(files(spark, d), DOCUMENTS)["containers"]


@query("version_chunk_diff", TWO + """
SELECT coalesce(x.file_id, y.file_id) AS file_id, coalesce(x.fp, y.fp) AS fp, CASE WHEN x.fp IS NULL THEN 'added' WHEN y.fp IS NULL THEN 'removed' ELSE 'kept' END AS status
FROM (SELECT DISTINCT file_id, fp FROM a) x FULL JOIN (SELECT DISTINCT file_id, fp FROM b) y ON x.file_id = y.file_id AND x.fp = y.fp""")
def _(spark, d):
    return diff.chunk_diff(fixed(spark, d), fixed2(spark, d))


REGIONS = TWO + """,
ao AS (SELECT file_id, fp, min(chunk_id) AS old_id FROM a GROUP BY ALL HAVING count(*) = 1),
bo AS (SELECT file_id, fp, min(chunk_id) AS new_id FROM b GROUP BY ALL HAVING count(*) = 1),
m AS (SELECT file_id, old_id, new_id, max(new_id) OVER (PARTITION BY file_id ORDER BY old_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ao JOIN bo USING (file_id, fp)),
pts AS (SELECT file_id, old_id, new_id FROM m WHERE top IS NULL OR new_id > top UNION ALL
  SELECT coalesce(x.file_id, y.file_id), coalesce(x.n, 0), coalesce(y.n, 0) FROM (SELECT file_id, max(chunk_id) + 1 AS n FROM a GROUP BY 1) x FULL JOIN (SELECT file_id, max(chunk_id) + 1 AS n FROM b GROUP BY 1) y ON x.file_id = y.file_id),
g AS (SELECT file_id, coalesce(lag(old_id) OVER w, -1) + 1 AS old_start, old_id - 1 AS old_end, coalesce(lag(new_id) OVER w, -1) + 1 AS new_start, new_id - 1 AS new_end FROM pts WINDOW w AS (PARTITION BY file_id ORDER BY old_id, new_id)),
regions AS (SELECT file_id, old_start::INT AS old_start, old_end::INT AS old_end, new_start::INT AS new_start, new_end::INT AS new_end,
  CASE WHEN old_end < old_start THEN 'insert' WHEN new_end < new_start THEN 'delete' ELSE 'modify' END AS kind FROM g WHERE NOT (old_end < old_start AND new_end < new_start)),
bu AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY file_id, chunk_id) = 1 AS is_unique FROM b)"""


@query("anchor_regions", REGIONS + " SELECT * FROM regions")
def _(spark, d):
    return diff.anchor_regions(fixed(spark, d), fixed2(spark, d))


@query("sliding_window_regions")
def _(spark, d):
    return diff.sliding_window_regions(fixed(spark, d), fixed2(spark, d))


@query("boundary_pairs", REGIONS + """,
pr AS (SELECT file_id, old_start AS o, new_start AS n FROM regions WHERE kind = 'modify' AND ((old_end > old_start AND new_end > new_start) OR (old_end = old_start AND new_end = new_start))
  UNION ALL SELECT file_id, old_end, new_end FROM regions WHERE kind = 'modify' AND old_end > old_start AND new_end > new_start)
SELECT pr.file_id, a.fp AS base_fp, bu.fp AS new_fp FROM pr JOIN a ON a.file_id = pr.file_id AND a.chunk_id = o JOIN bu ON bu.file_id = pr.file_id AND bu.chunk_id = n WHERE is_unique""")
def _(spark, d):
    old, new = fixed(spark, d), dedup.flag_first(fixed2(spark, d))
    return diff.positional_pairs(diff.anchor_regions(old, new), old, new)


@query("interior_chunks", REGIONS + " SELECT r.file_id, chunk_id, fp FROM regions r JOIN bu ON bu.file_id = r.file_id AND chunk_id > new_start AND chunk_id < new_end WHERE is_unique")
def _(spark, d):
    old, new = fixed(spark, d), dedup.flag_first(fixed2(spark, d))
    return diff.interior_chunks(diff.anchor_regions(old, new), new)


@query("region_metrics", TWO + """,
x AS (SELECT file_id, fp, sum(chunk_len) AS o FROM a GROUP BY ALL), y AS (SELECT file_id, fp, sum(chunk_len) AS n FROM b GROUP BY ALL)
SELECT coalesce(x.file_id, y.file_id) AS file_id, sum(CASE WHEN n IS NULL THEN o ELSE 0 END)::BIGINT AS old_only, sum(CASE WHEN o IS NULL THEN n ELSE 0 END)::BIGINT AS new_only, sum(CASE WHEN o IS NOT NULL AND n IS NOT NULL THEN n ELSE 0 END)::BIGINT AS kept
FROM x FULL JOIN y ON x.file_id = y.file_id AND x.fp = y.fp GROUP BY 1""")
def _(spark, d):
    return diff.region_metrics(fixed(spark, d), fixed2(spark, d))


@query("segment_prune_diff", f"""WITH RECURSIVE {cdc_sql('a')}, {cdc_sql('b', EDITED)}, {segments_sql('sa', 'a')}, {segments_sql('sb', 'b')},
x AS (SELECT DISTINCT a.file_id, fp FROM a JOIN sa ON a.file_id = sa.file_id AND chunk_id BETWEEN first AND last WHERE (sa.file_id, hash) NOT IN (SELECT file_id, hash FROM sb)),
y AS (SELECT DISTINCT b.file_id, fp FROM b JOIN sb ON b.file_id = sb.file_id AND chunk_id BETWEEN first AND last WHERE (sb.file_id, hash) NOT IN (SELECT file_id, hash FROM sa))
SELECT coalesce(x.file_id, y.file_id) AS file_id, coalesce(x.fp, y.fp) AS fp, CASE WHEN x.fp IS NULL THEN 'added' WHEN y.fp IS NULL THEN 'removed' ELSE 'kept' END AS status
FROM x FULL JOIN y ON x.file_id = y.file_id AND x.fp = y.fp""")
def _(spark, d):
    old, new = (chunking.chunks(f(spark, d), DOCUMENTS, payload=False) for f in (files, files2))
    return diff.pruned_diff(chunking.segments(old, DOCUMENTS), chunking.segments(new, DOCUMENTS), old, new)


E1 = "WITH e AS (SELECT vec_id, embedding, label FROM embeddings)"


def pairs(spark, d):
    """Each vector with the next one by id."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query("euclidean_pairs", "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    return pairs(spark, d).select("vec_id", F.round(scalar.euclidean(F.col("x"), F.col("y")), 6).alias("distance"))


@query("hamming_pairs", "SELECT a.vec_id, len(list_filter(range(len(a.embedding)), lambda i: (a.embedding[i+1] > 0) <> (b.embedding[i+1] > 0)))::INTEGER AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    sign = lambda c: F.transform(c, lambda v: v > 0)
    return pairs(spark, d).select("vec_id", scalar.hamming(sign("x"), sign("y")).alias("distance"))


@query("edit_distance_pairs", "SELECT a.c_custkey, levenshtein(a.c_name, b.n_name)::INTEGER AS distance FROM customer a JOIN nation b ON a.c_nationkey = b.n_nationkey")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(n, "c_nationkey").select("c_custkey", scalar.edit(F.col("c_name"), F.col("n_name")).alias("distance"))


def sketch(spark, d):
    """Four super-features of a whole text: the least hash of its words, four times."""
    t = F.coalesce("text", F.lit(""))
    least = lambda i: F.array_min(F.transform(F.split("t", " "), lambda w: F.md5(F.concat(F.lit(f"{i}:"), w).cast("binary"))))
    texts = table(spark, d, "documents").select(F.sha2(t, 256).alias("fp"), t.alias("t")).dropDuplicates(["fp"])
    return texts.select("fp", F.array(*[least(i) for i in range(4)]).alias("sf"))


SKETCH = "s AS (SELECT fp, list_transform([0, 1, 2, 3], lambda i: list_min(list_transform(string_split(t, ' '), lambda w: md5(i::VARCHAR || ':' || w)))) AS sf FROM (SELECT DISTINCT sha256(encode(coalesce(text, ''))) AS fp, coalesce(text, '') AS t FROM documents))"


@query("sf_overlap", f"WITH {SKETCH}, t AS (SELECT *, lead(sf) OVER (ORDER BY fp) AS nx FROM s) SELECT fp, len(list_intersect(sf, nx))::DOUBLE / len(sf) AS overlap FROM t WHERE nx IS NOT NULL")
def _(spark, d):
    return with_next(sketch(spark, d)).select("fp", scalar.distance("overlap", F.col("sf"), F.col("nx")).alias("overlap"))


def with_next(s: DataFrame) -> DataFrame:
    """Each row with the ``sf`` of the next one by ``fp``, as ``nx``.

    Neighbours within the partitions of a range sort; the last row of a
    partition is followed by the first of the next one that has rows, which
    takes one row for each partition.
    """
    parts = cut(s.repartitionByRange("fp").sortWithinPartitions("fp")).withColumn("p", F.spark_partition_id())
    inside = parts.withColumn("nx", F.lead("sf").over(Window.partitionBy("p").orderBy("fp")))
    firsts = parts.groupBy("p").agg(F.min(F.struct("fp", "sf")).alias("f"))
    order = Window.orderBy("p")
    follow = firsts.select("p", F.lead("f.sf").over(order).alias("after"))
    return inside.join(F.broadcast(follow), "p").withColumn("nx", F.coalesce("nx", "after")).where("nx is not null")


@query("similarity_groups", f"""WITH RECURSIVE {SKETCH},
p0 AS (SELECT fp, sf[1] AS g FROM s), g0 AS (SELECT g, min(fp) AS b FROM p0 GROUP BY g HAVING count(*) > 1), r0 AS (SELECT g AS group_sf, 0 AS sf_pos, fp AS member_fp, b AS base_fp FROM p0 JOIN g0 USING (g)),
s1 AS (SELECT * FROM s WHERE fp NOT IN (SELECT member_fp FROM r0)),
p1 AS (SELECT fp, sf[2] AS g FROM s1), g1 AS (SELECT g, min(fp) AS b FROM p1 GROUP BY g HAVING count(*) > 1), r1 AS (SELECT g AS group_sf, 1 AS sf_pos, fp AS member_fp, b AS base_fp FROM p1 JOIN g1 USING (g)),
s2 AS (SELECT * FROM s1 WHERE fp NOT IN (SELECT member_fp FROM r1)),
p2 AS (SELECT fp, sf[3] AS g FROM s2), g2 AS (SELECT g, min(fp) AS b FROM p2 GROUP BY g HAVING count(*) > 1), r2 AS (SELECT g AS group_sf, 2 AS sf_pos, fp AS member_fp, b AS base_fp FROM p2 JOIN g2 USING (g)),
s3 AS (SELECT * FROM s2 WHERE fp NOT IN (SELECT member_fp FROM r2)),
p3 AS (SELECT fp, sf[4] AS g FROM s3), g3 AS (SELECT g, min(fp) AS b FROM p3 GROUP BY g HAVING count(*) > 1), r3 AS (SELECT g AS group_sf, 3 AS sf_pos, fp AS member_fp, b AS base_fp FROM p3 JOIN g3 USING (g))
SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3""")
def _(spark, d):
    return similarity.groups(sketch(spark, d), 4)


@query("group_bases", f"WITH {SKETCH}, p AS (SELECT fp, unnest([1, 2, 3, 4]) AS k, unnest(sf) AS g FROM s) SELECT (k - 1)::INTEGER AS sf_pos, g AS group_sf, min(fp) AS base_fp, count(*)::BIGINT AS members FROM p GROUP BY k, g HAVING count(*) > 1")
def _(spark, d):
    g = similarity.groups(sketch(spark, d), 4, overlapping=True)
    return g.groupBy("sf_pos", "group_sf").agg(F.min("base_fp").alias("base_fp"), F.count("*").alias("members"))


for _method in similarity.EXTRACTORS:

    @query(f"{_method}_features")
    def _(spark, d, method=_method):
        c = fixed(spark, d, True).select("fp", "data").dropDuplicates(["fp"])
        return c.select("fp", similarity.features(F.col("data"), method).alias("features"))


@query("super_features")
def _(spark, d):
    return similarity.sketches(fixed(spark, d, True))


def version_deltas(spark, d):
    old, new = fixed(spark, d, True), dedup.flag_first(fixed2(spark, d, True))
    found = diff.positional_pairs(diff.anchor_regions(old, new), old, new)
    return delta.encode_pairs(found, old.select("fp", "data").unionByName(new.select("fp", "data")), tail=2)


@query("delta_report_positional")
def _(spark, d):
    return delta.report(version_deltas(spark, d))


def group_deltas(spark, d):
    c = cut(chunking.chunks(files(spark, d), DOCUMENTS))
    return delta.encode_pairs(delta.group_pairs(similarity.groups(similarity.sketches(c), 4)), c)


@query("delta_report_groups")
def _(spark, d):
    return delta.report(group_deltas(spark, d))


@query("delta_round_trip", "SELECT 0::BIGINT AS mismatches")
def _(spark, d):
    x = cut(version_deltas(spark, d))
    data = fixed(spark, d, True).select("fp", "data").unionByName(fixed2(spark, d, True).select("fp", "data")).dropDuplicates(["fp"])
    both = x.join(data.select(F.col("fp").alias("base_fp"), F.col("data").alias("base")), "base_fp")
    made = both.select("new_fp", F.sha2(delta.apply_udf("base", "delta"), 256).alias("got"), delta.size_column(F.col("delta")).alias("size"), "new_len")
    return made.agg(F.coalesce(F.sum(((F.col("got") != F.col("new_fp")) | (F.col("size") != F.col("new_len"))).cast("long")), F.lit(0)).alias("mismatches"))


@query("container_packing", ONE + """
SELECT file_id, chunk_id, fp, chunk_len, (before // 4096)::BIGINT AS container_id, (before % 4096)::BIGINT AS "offset"
FROM (SELECT *, coalesce(sum(chunk_len) OVER (PARTITION BY file_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c)""")
def _(spark, d):
    return store.pack(fixed(spark, d), 4096)


def fill_sql(name: str, of: str, cap: int) -> str:
    """CTEs: containers of ``of(fp, lane, chunk_len)``, lane by lane in order of fp."""
    over = f"{name}_f.used + {name}_f.chunk_len + {name}_r.chunk_len >= {cap}"
    return f"""{name}_r AS MATERIALIZED (SELECT fp, lane, chunk_len, row_number() OVER (PARTITION BY lane ORDER BY fp) AS k FROM {of}),
{name}_f AS (SELECT fp, lane, chunk_len, k, 0::BIGINT AS container_id, 0::BIGINT AS used FROM {name}_r WHERE k = 1
  UNION ALL SELECT {name}_r.fp, {name}_r.lane, {name}_r.chunk_len, {name}_r.k, {name}_f.container_id + ({over})::INT, CASE WHEN {over} THEN 0 ELSE {name}_f.used + {name}_f.chunk_len END
  FROM {name}_f JOIN {name}_r ON {name}_r.lane = {name}_f.lane AND {name}_r.k = {name}_f.k + 1),
{name} AS MATERIALIZED (SELECT fp, lane, container_id, used AS "offset", chunk_len FROM {name}_f)"""


PACKED = f"""WITH RECURSIVE {chunks_sql()}, o AS (SELECT fp, max(chunk_len) AS chunk_len FROM c GROUP BY fp),
l AS (SELECT fp, chunk_len, (('0x' || substr(fp, 1, 8))::BIGINT % (SELECT greatest(1, ceil(sum(chunk_len) / {store.PER_LANE * 65536.0}))::BIGINT FROM o))::INTEGER AS lane FROM o), {fill_sql("p", "l", 65536)}"""


@query("container_packing_exact", PACKED + " SELECT * FROM p")
def _(spark, d):
    return store.pack_exact(fixed(spark, d), 65536)


@query("container_compaction", PACKED + f""",
k AS MATERIALIZED (SELECT * FROM p WHERE fp IN (SELECT fp FROM c JOIN documents ON doc_id = file_id WHERE lang <> 'en')),
z AS MATERIALIZED (SELECT lane, container_id, sum(chunk_len) AS n, max(container_id) OVER (PARTITION BY lane) AS top FROM k GROUP BY lane, container_id),
m AS (SELECT k.*, top, n <= 60000 AND container_id < top AS move FROM k JOIN z USING (lane, container_id)),
mv AS (SELECT fp, lane, chunk_len FROM m WHERE move), {fill_sql("q", "mv", 65536)}
SELECT fp, lane, container_id, "offset", chunk_len FROM m WHERE NOT move
UNION ALL SELECT fp, lane, container_id + top + 1, "offset", chunk_len FROM q JOIN (SELECT DISTINCT lane, top FROM z) USING (lane)""")
def _(spark, d):
    c = fixed(spark, d)
    live = c.join(table(spark, d, "documents").where("lang <> 'en'").select(F.col("doc_id").alias("file_id")), "file_id", "left_semi")
    return store.compact(cut(store.pack_exact(c, 65536)), live, 60000, 65536)


RESTORED = "SELECT doc_id AS file_id, sha256(encode({0})) AS sha, true AS complete FROM documents WHERE {0} <> ''"


def _restored(df):
    return df.select("file_id", F.sha2("content", 256).alias("sha"), "complete")


@query("restore_files", RESTORED.format("coalesce(text, '')"))
def _(spark, d):
    c = chunking.chunks(files(spark, d), DOCUMENTS)
    return _restored(store.restore(c.drop("data"), store.payload_store(c)))


@query("apply_deltas_restore", RESTORED.format(f"({EDITED})"))
def _(spark, d):
    old, new = fixed(spark, d, True), fixed2(spark, d, True)
    payload = store.payload_store(old.select("fp", "data").unionByName(new.select("fp", "data")))
    return _restored(store.restore(new.drop("data"), store.apply_deltas(payload, cut(version_deltas(spark, d)))))


@query("restore_range", ONE + " SELECT file_id, sha256(unhex(string_agg(h, '' ORDER BY chunk_id))) AS sha, true AS complete FROM (SELECT c_i.file_id, i AS chunk_id, substr(h, i * 1024 + 1, 1024) AS h FROM c_i WHERE i BETWEEN 1 AND 2) GROUP BY file_id")
def _(spark, d):
    c = fixed(spark, d, True)
    return _restored(store.restore(c.drop("data"), store.payload_store(c), 1, 3))


def stage_query(name: str, base: str, pipeline: list[dict], sql: str, finish=None, tables=()) -> None:
    @query(name, sql)
    def _(spark, d):
        df = stages.run(table(spark, d, base), pipeline, {t: table(spark, d, t) for t in tables})
        return finish(df) if finish else df


stage_query("agg_match", "events", [{"$match": {"event_type": "error", "value": {"$gt": 1.0}}}, {"$project": {"event_id": 1, "value": 1}}], "SELECT event_id, value FROM events WHERE event_type = 'error' AND value > 1")
stage_query("agg_add_fields", "part", [{"$addFields": {"double_size": {"$multiply": ["$p_size", 2]}}}, {"$project": {"p_partkey": 1, "double_size": 1}}], "SELECT p_partkey, p_size * 2 AS double_size FROM part")
stage_query("agg_bucket", "part", [{"$bucket": {"groupBy": "$p_size", "boundaries": [0, 10, 20, 30, 60]}}], "SELECT CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 10 WHEN p_size < 30 THEN 20 ELSE 30 END AS _id, count(*)::BIGINT AS count FROM part GROUP BY 1")
stage_query("agg_bucket_auto", "orders", [{"$bucketAuto": {"groupBy": "$o_totalprice", "buckets": 4}}], "SELECT min(v) AS min, max(v) AS max, count(*)::BIGINT AS count FROM (SELECT o_totalprice AS v, (rank() OVER (ORDER BY o_totalprice) - 1) * 4 // count(*) OVER () AS b FROM orders) GROUP BY b", lambda df: df.select("_id.*", "count"))
stage_query("agg_coll_stats", "orders", [{"$collStats": {}}], "SELECT count(*)::BIGINT AS count FROM orders")
stage_query("agg_count", "lineitem", [{"$match": {"l_returnflag": "R"}}, {"$count": "n"}], "SELECT count(*)::BIGINT AS n FROM lineitem WHERE l_returnflag = 'R' HAVING count(*) > 0")
stage_query("agg_facet", "nation", [{"$facet": {"regions": [{"$group": {"_id": "$n_regionkey"}}], "nations": [{"$count": "n"}]}}], "SELECT count(DISTINCT n_regionkey)::INTEGER AS regions, count(*)::BIGINT AS nations FROM nation", lambda df: df.select(F.size("regions").alias("regions"), F.get("nations.n", 0).alias("nations")))
stage_query("agg_geo_near", "customer", [{"$addFields": {"at": [{"$add": ["$c_nationkey", 0.0]}, {"$add": ["$c_acctbal", 0.0]}]}}, {"$geoNear": {"key": "$at", "near": [10.0, 0.0], "distanceField": "far"}}], "SELECT c_custkey, round(sqrt((c_nationkey - 10) ** 2 + c_acctbal ** 2), 6) AS far FROM customer", lambda df: df.select("c_custkey", F.round("far", 6).alias("far")))
stage_query("agg_group", "lineitem", [{"$group": {"_id": "$l_returnflag", "n": {"$sum": 1}, "quantity": {"$sum": "$l_quantity"}, "top": {"$max": "$l_extendedprice"}}}], "SELECT l_returnflag AS _id, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity, max(l_extendedprice) AS top FROM lineitem GROUP BY 1", lambda df: df.withColumn("quantity", F.round("quantity", 2)))
stage_query("agg_limit", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 20}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
stage_query("agg_skip", "region", [{"$sort": {"r_regionkey": 1}}, {"$skip": 2}], "SELECT * FROM region ORDER BY r_regionkey OFFSET 2")
stage_query("agg_sort", "supplier", [{"$sort": {"s_acctbal": -1, "s_suppkey": 1}}, {"$project": {"s_suppkey": 1, "s_acctbal": 1}}], "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
stage_query("agg_lookup", "nation", [{"$lookup": {"from": "supplier", "localField": "n_nationkey", "foreignField": "s_nationkey", "as": "suppliers"}}], "SELECT n_nationkey, count(s_suppkey)::INTEGER AS n, round(coalesce(sum(s_acctbal), 0), 2) AS balance FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1", lambda df: df.select("n_nationkey", F.size("suppliers").alias("n"), F.round(F.aggregate("suppliers.s_acctbal", F.lit(0.0), lambda a, x: a + x), 2).alias("balance")), ("supplier",))
stage_query("agg_project", "orders", [{"$project": {"o_orderkey": 1, "priority": {"$toLower": "$o_orderpriority"}}}], "SELECT o_orderkey, lower(o_orderpriority) AS priority FROM orders")
stage_query("agg_replace_root", "customer", [{"$project": {"doc": {"key": "$c_custkey", "segment": "$c_mktsegment"}}}, {"$replaceRoot": {"newRoot": "$doc"}}], "SELECT c_custkey AS key, c_mktsegment AS segment FROM customer")
stage_query("agg_sort_by_count", "events", [{"$sortByCount": "$event_type"}], "SELECT event_type AS _id, count(*)::BIGINT AS count FROM events GROUP BY 1")
stage_query("agg_sort_by_count_mod", "orders", [{"$sortByCount": {"$mod": ["$o_custkey", 7]}}], "SELECT o_custkey % 7 AS _id, count(*)::BIGINT AS count FROM orders GROUP BY 1")
stage_query("agg_unwind", "embeddings", [{"$unwind": {"path": "$embedding", "includeArrayIndex": "i"}}, {"$project": {"vec_id": 1, "i": 1, "embedding": 1}}], "SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS i, unnest(embedding) AS embedding FROM embeddings")
stage_query("agg_redact", "customer", [{"$project": {"c_custkey": 1, "balance": {"secret": {"$cond": [{"$lt": ["$c_acctbal", 0.0]}, 1, 0]}, "amount": "$c_acctbal"}}}, {"$redact": {"$cond": [{"$eq": ["$secret", 1]}, "$$PRUNE", "$$DESCEND"]}}], "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS amount FROM customer", lambda df: df.select("c_custkey", F.col("balance.amount").alias("amount")))


@query("agg_collation", "SELECT lower(c_mktsegment) AS _id, count(*)::BIGINT AS n FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') GROUP BY 1")
def _(spark, d):
    mixed = table(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.initcap("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    out = stages.run(mixed, [{"$match": {"c_mktsegment": {"$in": ["BUILDING", "machinery"]}}}, {"$group": {"_id": "$c_mktsegment", "n": {"$sum": 1}}}], collation="UTF8_LCASE")
    return out.select(F.lower(F.collate("_id", "UTF8_BINARY")).alias("_id"), "n")


@query("agg_sample_hash", "SELECT o_orderkey FROM orders ORDER BY sha256(o_orderkey::VARCHAR), o_orderkey LIMIT 50")
def _(spark, d):
    return stages.sample_hash(table(spark, d, "orders"), "o_orderkey", 50).select("o_orderkey")


@query("agg_graph_lookup", """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS id, NULL AS up FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
w AS (SELECT id AS origin, up AS node FROM e UNION SELECT origin, e.up FROM w JOIN e ON e.id = w.node)
SELECT e.id, coalesce(n, 0)::INTEGER AS ancestors FROM e LEFT JOIN (SELECT origin, count(DISTINCT node) AS n FROM w GROUP BY 1) ON origin = e.id""")
def _(spark, d):
    e = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("up"))
    e = e.unionByName(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("up")))
    e = e.unionByName(table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("up")))
    out = stages.run(e, [{"$graphLookup": {"from": "e", "startWith": "$up", "connectFromField": "up", "connectToField": "id", "as": "above"}}], {"e": e})
    return out.select("id", F.size("above").alias("ancestors"))


@query("agg_merge", "SELECT n_nationkey AS id, upper(n_name) AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    tables = {"target": n.drop("n_regionkey")}
    stages.run(n, [{"$match": {"n_regionkey": 1}}, {"$project": {"id": 1, "name": {"$toUpper": "$name"}}}, {"$merge": {"into": "target", "on": "id"}}], tables)
    return tables["target"]


@query("agg_out", "SELECT r_regionkey FROM region")
def _(spark, d):
    tables = {}
    stages.run(table(spark, d, "region"), [{"$project": {"r_regionkey": 1}}, {"$out": "copy"}], tables)
    return tables["copy"]


@query("distinct_values", "SELECT DISTINCT event_type AS value FROM events WHERE value > 2")
def _(spark, d):
    return collection.distinct(table(spark, d, "events"), "event_type", {"value": {"$gt": 2.0}})


@query("count_documents", "SELECT count(*)::BIGINT AS n FROM documents WHERE lang = 'en' OR n_chars % 2 = 0")
def _(spark, d):
    return collection.count_documents(table(spark, d, "documents"), {"$or": [{"lang": "en"}, {"n_chars": {"$mod": [2, 0]}}]})


@query("update_many", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def _(spark, d):
    return collection.update_many(table(spark, d, "supplier"), {"s_acctbal": {"$lt": 0.0}}, {"s_acctbal": 0.0}).select("s_suppkey", "s_acctbal")


@query("replace_upsert", "SELECT n_nationkey AS key, n_name AS name FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    old = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return collection.replace(old, table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), "key")


@query("delete_many", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def _(spark, d):
    return collection.delete_many(table(spark, d, "orders"), {"o_orderstatus": "F"}).select("o_orderkey")


@query("bulk_fold", """WITH w AS (SELECT user_id, max_by(event_type, event_id) AS op, max_by(value, event_id) AS v FROM events GROUP BY user_id)
SELECT c_custkey AS key, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM w) UNION ALL SELECT user_id, v FROM w WHERE op <> 'error'""")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    writes = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "error", "del").otherwise("put").alias("op"), "value")
    return collection.bulk(c, writes, "key")


@query("find_options", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 40 ORDER BY p_size DESC, p_partkey LIMIT 15 OFFSET 5")
def _(spark, d):
    return collection.find(table(spark, d, "part"), None, ["p_partkey", "p_size"], {"p_size": -1, "p_partkey": 1}, 5, 15, {"p_size": 10}, {"p_size": 40})


@query("gridfs_chunks", f"WITH {chunks_sql(size=collection.GRID_CHUNK)} SELECT file_id, chunk_id AS n, chunk_len FROM c")
def _(spark, d):
    return collection.grid_upload(files(spark, d)).select("file_id", "n", "chunk_len")


@query("gridfs_reassemble", "SELECT doc_id AS file_id, sha256(encode(text)) AS sha FROM documents WHERE text <> ''")
def _(spark, d):
    return collection.grid_download(collection.grid_upload(files(spark, d), 1000)).select("file_id", F.sha2("content", 256).alias("sha"))


def log(spark, d):
    e = table(spark, d, "events")
    dead = F.col("event_type") == "error"
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(dead, "del").otherwise("put").alias("op"), F.when(~dead, F.col("value")).alias("value"))


LOG = "WITH l AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'del' ELSE 'put' END AS op, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"
LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM l {0}) WHERE r = 1 AND op = 'put'"


@query("kv_get_latest", f"{LOG} SELECT key, value, seq FROM ({LAST.format('')})")
def _(spark, d):
    return kv.latest(log(spark, d))


@query("kv_snapshot_get", f"{LOG} SELECT key, value, seq FROM ({LAST.format('WHERE seq <= 500')})")
def _(spark, d):
    return kv.latest(log(spark, d), 500)


@query("kv_range_scan", f"{LOG} SELECT key, value, seq FROM ({LAST.format('WHERE key >= 10 AND key < 90')}) ORDER BY key")
def _(spark, d):
    return kv.scan(log(spark, d), 10, 90)


@query("kv_reverse_scan", f"{LOG} SELECT key, value, seq FROM ({LAST.format('WHERE key >= 10 AND key < 90')}) ORDER BY key DESC")
def _(spark, d):
    return kv.scan(log(spark, d), 10, 90, reverse=True)


@query("kv_compact", f"{LOG} SELECT key, seq, op, value FROM ({LAST.format('WHERE seq <= 700')}) UNION ALL SELECT key, seq, op, value FROM l WHERE seq > 700")
def _(spark, d):
    return kv.compact(log(spark, d), 700)


@query("kv_approx_size", f"{LOG} SELECT coalesce(sum(length(key::VARCHAR) + coalesce(length(round(value * 100)::BIGINT::VARCHAR), 0)), 0)::BIGINT AS bytes FROM l WHERE key >= 5 AND key < 500")
def _(spark, d):
    rows = log(spark, d).withColumn("value", F.round(F.col("value") * 100).cast("long"))
    return kv.approximate_size(rows, 5, 500)


@query("kv_compact_snapshots", f"""{LOG}, k AS (SELECT *, (seq > 300)::INT + (seq > 700)::INT AS span FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY key, span ORDER BY seq DESC) AS r FROM k WHERE span < 2)
SELECT key, seq, op, value FROM r WHERE r = 1 AND (op = 'put' OR span > 0) UNION ALL SELECT key, seq, op, value FROM k WHERE span = 2""")
def _(spark, d):
    return kv.compact(log(spark, d), [300, 700])


@query("kv_store_files", f"{LOG} SELECT key, value, seq FROM ({LAST.format('')}) WHERE key % 7 = 1")
def _(spark, d):
    path = streams.shared_folder(spark)
    kv.open_store(spark, f"{path}/log", "bigint", "double")
    kv.write_sorted(log(spark, d), f"{path}/log", 4)
    again = kv.repair(spark, f"{path}/log", f"{path}/again", 2, "bigint", "double")
    return kv.latest(again.where(F.col("key") % 7 == 1))


@query("kv_batch", f"{LOG}, w AS (SELECT key, seq, op, value FROM l UNION ALL SELECT c_custkey, 10000000 + c_custkey + 1, CASE WHEN c_acctbal < 0 THEN 'del' ELSE 'put' END, CASE WHEN c_acctbal >= 0 THEN c_acctbal END FROM customer) SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM w) WHERE r = 1 AND op = 'put'")
def _(spark, d):
    gone = F.col("c_acctbal") < 0
    writes = table(spark, d, "customer").select(F.col("c_custkey").alias("at"), F.col("c_custkey").alias("key"), F.when(gone, "del").otherwise("put").alias("op"), F.when(~gone, F.col("c_acctbal")).alias("value"))
    return kv.latest(kv.batch(log(spark, d), writes, 10_000_000))


@query("kv_statistics", f"{LOG} SELECT count(*)::BIGINT AS entries, sum((op = 'del')::INT)::BIGINT AS tombstones, count(DISTINCT key)::BIGINT AS keys, min(seq) AS first_seq, max(seq) AS last_seq FROM l")
def _(spark, d):
    return kv.statistics(log(spark, d))


@query("stream_incremental_dedup", ONE + " SELECT DISTINCT fp, chunk_len FROM c")
def _(spark, d):
    docs = streams.table_stream(spark, f"{d}/documents.parquet")
    return streams.ingest(chunking.chunks(text_files(docs, "doc_id"), FIXED, payload=False), streams.shared_folder(spark))


@query("stream_change_filter", "SELECT event_id, event_type FROM events WHERE event_type = 'error' OR value > 3")
def _(spark, d):
    changes = streams.watch(streams.table_stream(spark, f"{d}/events.parquet"), {"$or": [{"event_type": "error"}, {"value": {"$gt": 3.0}}]})
    return streams.run_once(changes.select("event_id", "event_type"), streams.shared_folder(spark))


@query("ext_tumbling_events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    return streams.tumbling(table(spark, d, "events"))


@query("ext_session_events", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def _(spark, d):
    return streams.sessions(table(spark, d, "events"))


@query("conversation_reassembly", "SELECT conv_id, count(*)::BIGINT AS turns, sha256(encode(string_agg(role || ': ' || text, chr(10) ORDER BY turn))) AS sha FROM conversations GROUP BY conv_id")
def _(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sha2(F.array_join(F.transform(parts, lambda x: x["line"]), "\n"), 256).alias("sha"))


TWICE = TWO + ", x AS (SELECT 0 AS version, * FROM a UNION ALL SELECT CASE WHEN file_id IN (SELECT file_id FROM a) THEN 1 ELSE 0 END, * FROM b)"


def ingested(spark, d) -> tuple[backup.Store, DataFrame]:
    """A store with both versions of the documents, and the reports of both ingests."""
    kept = backup.Store(spark, streams.shared_folder(spark), FIXED, "bigint")
    reports = kept.ingest(files(spark, d)).unionByName(kept.ingest(files2(spark, d)))
    return kept, reports


@query("ingest_versions", TWICE + """, f AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY file_id NOT IN (SELECT file_id FROM a) OR version = 1, version, file_id, chunk_id) = 1 AS is_new FROM x)
SELECT file_id, version, sum(chunk_len)::BIGINT AS file_size, count(*)::BIGINT AS total_chunks, sum(is_new::INT)::BIGINT AS new_chunks, sum(CASE WHEN is_new THEN chunk_len ELSE 0 END)::BIGINT AS new_bytes FROM f GROUP BY file_id, version""")
def _(spark, d):
    return ingested(spark, d)[1]


@query("next_version", TWICE + " SELECT file_id, max(version) + 1 AS next_version, max(version) AS previous_version FROM x GROUP BY file_id")
def _(spark, d):
    return ingested(spark, d)[0].versions()


@query("store_upsert", TWICE + " SELECT fp, max(chunk_len) AS chunk_len, count(*)::BIGINT AS ref_count FROM x GROUP BY fp")
def _(spark, d):
    return ingested(spark, d)[0].counts()


@query("store_containers", TWICE.replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (SELECT fp, max(chunk_len) AS chunk_len FROM x GROUP BY fp),
l AS (SELECT fp, chunk_len, (('0x' || substr(fp, 1, 8))::BIGINT % (SELECT greatest(1, ceil(sum(chunk_len) / {float(store.PER_LANE * FIXED.container_cap)}))::BIGINT FROM o))::INTEGER AS lane FROM o), {fill_sql("p", "l", FIXED.container_cap)} SELECT * FROM p""")
def _(spark, d):
    return ingested(spark, d)[0].containers()


@query("probe_known", TWO + " SELECT file_id, chunk_id, fp FROM b WHERE fp IN (SELECT fp FROM a)")
def _(spark, d):
    kept = backup.Store(spark, streams.shared_folder(spark), FIXED, "bigint")
    kept.ingest(files(spark, d))
    return kept.probe(fixed2(spark, d)).select("file_id", "chunk_id", "fp")


@query("probe_unknown", TWO + " SELECT file_id, chunk_id, fp FROM b WHERE fp NOT IN (SELECT fp FROM a)")
def _(spark, d):
    kept = backup.Store(spark, streams.shared_folder(spark), FIXED, "bigint")
    kept.ingest(files(spark, d))
    return kept.probe(fixed2(spark, d), known=False).select("file_id", "chunk_id", "fp")


@query("version_changes", REGIONS + " SELECT * FROM regions WHERE file_id IN (SELECT file_id FROM a) AND file_id IN (SELECT file_id FROM b)")
def _(spark, d):
    both = fixed(spark, d).select("file_id").distinct()
    return ingested(spark, d)[0].changes().join(both, "file_id", "left_semi").join(fixed2(spark, d).select("file_id").distinct(), "file_id", "left_semi")


@query("raw_chunks", TWICE + " SELECT x.file_id, chunk_id, chunk_len FROM x JOIN (SELECT file_id, max(version) AS version FROM x GROUP BY 1) USING (file_id, version)")
def _(spark, d):
    kept = ingested(spark, d)[0]
    kept.save_deltas()
    return kept.raw().where("data is not null or delta is not null").select("file_id", "chunk_id", "chunk_len")


@query("delta_store_restore", f"SELECT doc_id AS file_id, sha256(encode(CASE WHEN ({EDITED}) <> '' THEN ({EDITED}) ELSE text END)) AS sha, true AS complete FROM documents WHERE ({EDITED}) <> '' OR text <> ''")
def _(spark, d):
    kept = ingested(spark, d)[0]
    kept.save_deltas()
    return _restored(kept.restore(deltas=True))


@query("restored_files", "SELECT doc_id::VARCHAR AS name, 0 AS version, sha256(encode(text)) AS sha FROM documents WHERE text <> ''")
def _(spark, d):
    kept = backup.Store(spark, streams.shared_folder(spark), DOCUMENTS, "bigint")
    kept.ingest(files(spark, d))
    path = f"{streams.shared_folder(spark)}/files"
    write_files(kept.restore(), path)
    return spark.read.parquet(path).select("name", "version", F.sha2("content", 256).alias("sha"))


@query("restored_parts", ONE + ", p AS (SELECT file_id, byte_off // 2048 AS part_no, min(byte_off) AS byte_off, sum(chunk_len) AS n FROM c GROUP BY ALL) SELECT file_id, part_no::BIGINT AS part_no, p.byte_off::BIGINT AS byte_off, sha256(unhex(substr(h, 2 * p.byte_off + 1, 2 * n::BIGINT))) AS sha, true AS complete FROM p JOIN c_f USING (file_id)")
def _(spark, d):
    kept = backup.Store(spark, streams.shared_folder(spark), FIXED, "bigint")
    kept.ingest(files(spark, d))
    return kept.restore_parts(part=2048).select("file_id", "part_no", "byte_off", F.sha2("content", 256).alias("sha"), "complete")


@query("md5_names", "SELECT doc_id, md5(coalesce(text, '')) AS name FROM documents")
def _(spark, d):
    return files(spark, d).select(F.col("file_id").alias("doc_id"), scalar.md5_fingerprint(F.col("content")).alias("name"))


@query("byte_dump", "SELECT n_nationkey, array_to_string(regexp_extract_all(hex(encode(n_name)), '..'), ' ') AS bytes FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", scalar.byte_dump(F.encode("n_name", "UTF-8")).alias("bytes"))


@query("varint_round_trip", "SELECT o_orderkey, o_orderkey AS back, greatest(1, ceil(length(bin(o_orderkey)) / 7.0))::INTEGER AS n FROM orders")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", scalar.varint(F.col("o_orderkey")).alias("v"))
    return rows.select("o_orderkey", scalar.from_varint(F.col("v")).alias("back"), F.octet_length("v").alias("n"))


@query("hash32", """WITH b AS (SELECT n_nationkey, n_name, length(n_name) AS n, list_transform(range(1, length(n_name) + 1), lambda i: ascii(substr(n_name, i, 1))::UBIGINT) AS v FROM nation),
h AS (SELECT *, list_reduce(list_prepend((xor(3164544308, n * 3332679571::HUGEINT)::HUGEINT % 4294967296)::UBIGINT, list_transform(range(0, n // 4), lambda i: v[4*i+1] + v[4*i+2] * 256 + v[4*i+3] * 65536 + v[4*i+4] * 16777216)),
  lambda a, w: xor(((a + w) * 3332679571::HUGEINT % 4294967296)::UBIGINT, ((a + w) * 3332679571::HUGEINT % 4294967296)::UBIGINT >> 16)) AS h FROM b),
r AS (SELECT n_nationkey, n, h, CASE n % 4 WHEN 0 THEN 0 WHEN 1 THEN v[n] WHEN 2 THEN v[n-1] + v[n] * 256 ELSE v[n-2] + v[n-1] * 256 + v[n] * 65536 END AS w FROM h)
SELECT n_nationkey, CASE WHEN n % 4 = 0 THEN h ELSE xor(((h + w) * 3332679571::HUGEINT % 4294967296)::UBIGINT, ((h + w) * 3332679571::HUGEINT % 4294967296)::UBIGINT >> 24) END::BIGINT AS hash FROM r""")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", scalar.hash32(F.encode("n_name", "UTF-8")).alias("hash"))


@query("bits_distance", "SELECT o_orderkey, bit_count(xor(o_orderkey, o_custkey))::INTEGER AS distance FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalar.distance("bits", F.col("o_orderkey"), F.col("o_custkey")).alias("distance"))


@query("out_written", "SELECT n_nationkey, upper(n_name) AS name FROM nation")
def _(spark, d):
    db = Collections(spark, streams.shared_folder(spark))
    stages.run(table(spark, d, "nation"), [{"$project": {"n_nationkey": 1, "name": {"$toUpper": "$n_name"}}}, {"$out": "copy"}], db)
    return db["copy"]


@query("merge_written", "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS name FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region")
def _(spark, d):
    db = Collections(spark, streams.shared_folder(spark))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    db.create("nations", n.drop("n_regionkey"), {"id": {"$exists": True}})
    stages.run(n, [{"$match": {"n_regionkey": 1}}, {"$project": {"id": 1, "name": {"$toLower": "$name"}}}, {"$merge": {"into": "nations", "on": "id"}}], db)
    more = table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name"))
    stages.run(more, [{"$merge": {"into": "nations", "on": "id"}}], db)
    db.rename("nations", "all_nations")
    return db["all_nations"]


@query("update_upsert", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 99, 'NOWHERE'")
def _(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    n = collection.update_many(n, {"n_nationkey": 99}, {"n_name": "NOWHERE"}, upsert=True)
    return collection.update_many(n, {"n_nationkey": 99}, {"n_name": "NOWHERE"}, upsert=True)


@query("update_pipeline", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN lower(c_name) ELSE c_name END AS c_name FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return collection.update_pipeline(c, {"c_acctbal": {"$lt": 0.0}}, [{"$set": {"c_name": {"$toLower": "$c_name"}}}]).select("c_custkey", "c_name")


@query("bulk_models", "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 2 THEN 'one' WHEN n_nationkey > 20 THEN 'many' WHEN n_nationkey = 4 THEN 'replaced' ELSE n_name END AS v FROM nation WHERE n_nationkey NOT IN (5, 6, 7) UNION ALL SELECT 100, 'new'")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    models = [("insert_one", {"k": 100, "v": "new"}), ("update_one", {"k": {"$gte": 2}}, {"v": "one"}), ("update_many", {"k": {"$gt": 20, "$lt": 99}}, {"v": "many"})]
    models += [("replace_one", {"k": 4, "v": "replaced"}), ("replace_one", {"k": 500, "v": "not there"}), ("delete_one", {"k": {"$gte": 5}}), ("delete_many", {"k": {"$in": [6, 7]}})]
    return collection.bulk_write(n, models, "k")


@query("find_one_and_update", "SELECT s_suppkey, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_acctbal > 0)")
def _(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    after = collection.update_one(s, {"s_acctbal": {"$gt": 0.0}}, {"s_acctbal": {"$add": ["$s_acctbal", 1.0]}}, "s_suppkey")
    return collection.find_one_and(s, after, {"s_acctbal": {"$gt": 0.0}}, "s_suppkey", new=True)


@query("array_filters", "SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x < 0 THEN 0 ELSE x END) AS embedding FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return collection.update_elements(e, "embedding", lambda x: x < 0, lambda x: F.lit(0.0).cast(e.schema["embedding"].dataType.elementType))


@query("unique_violations", "SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return collection.unique_violations(table(spark, d, "orders"), "o_custkey")


@query("unexpired", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND")
def _(spark, d):
    e = table(spark, d, "events")
    return collection.unexpired(e, "ts", 3600, e.agg(F.max("ts").alias("t")).first()["t"]).select("event_id")


@query("capped_collection", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def _(spark, d):
    return collection.capped(table(spark, d, "events"), 100, "event_id").select("event_id", "event_type")


@query("estimated_count", "SELECT count(*)::BIGINT AS n FROM lineitem")
def _(spark, d):
    return spark.createDataFrame([(collection.estimated_count(spark, f"{d}/lineitem.parquet"),)], "n long")


@query("grid_find", f"WITH {chunks_sql(size=1000)} SELECT file_id, sum(chunk_len)::BIGINT AS length, count(*)::BIGINT AS chunks FROM c GROUP BY file_id HAVING count(*) > 2")
def _(spark, d):
    return collection.grid_find(collection.grid_upload(files(spark, d), 1000), {"chunks": {"$gt": 2}})


@query("grid_delete", f"WITH {chunks_sql(size=1000)} SELECT file_id, chunk_id AS n FROM c WHERE file_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(spark, d):
    gone = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("file_id"))
    return collection.grid_delete(collection.grid_upload(files(spark, d), 1000), gone).select("file_id", "n")


@query("find_collation", "SELECT p_partkey, p_brand FROM part WHERE lower(p_brand) = (SELECT lower(min(p_brand)) FROM part) ORDER BY p_partkey")
def _(spark, d):
    p = table(spark, d, "part")
    want = p.agg(F.min("p_brand").alias("b")).first()["b"].swapcase()
    return collection.find(p, {"p_brand": want}, ["p_partkey", "p_brand"], {"p_partkey": 1}, collation="UTF8_LCASE")


@query("asof_events", """SELECT l.event_id, r.value AS last_value FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') l
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type <> 'error' GROUP BY user_id, ts) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def _(spark, d):
    e = table(spark, d, "events")
    right = e.where("event_type <> 'error'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return joins.asof(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), right, "user_id", "ts").select("event_id", "last_value")


@query("set_intersect", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders")
def _(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")).intersect(table(spark, d, "orders").select("o_custkey"))


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey"))


@query("sql_entry", "SELECT r_name, count(*)::BIGINT AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def _(spark, d):
    views(spark, d, ["region", "nation", "customer"], "v_")
    return spark.sql("SELECT r_name, count(*) AS n FROM v_region JOIN v_nation ON n_regionkey = r_regionkey JOIN v_customer ON c_nationkey = n_nationkey GROUP BY r_name")


@query("stream_resume", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    """Two runs of one stream: the second goes on where the first ended."""
    folder = streams.shared_folder(spark)
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    for part in ("n_nationkey < 10", "n_nationkey >= 10"):
        n.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = streams.run_once(spark.readStream.schema(n.schema).parquet(f"{folder}/in"), f"{folder}/job")
    return out


@query("stream_start_at", "SELECT event_id FROM events WHERE event_id >= 500 AND event_type = 'error'")
def _(spark, d):
    changes = streams.start_at(streams.watch(streams.table_stream(spark, f"{d}/events.parquet"), {"event_type": "error"}), "event_id", 500)
    return streams.run_once(changes.select("event_id"), streams.shared_folder(spark))


@query("stream_full_document", "SELECT event_id, c_name FROM events LEFT JOIN customer ON c_custkey = user_id WHERE event_type = 'error'")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    changes = streams.watch(streams.table_stream(spark, f"{d}/events.parquet"), {"event_type": "error"})
    return streams.run_once(streams.full_document(changes, c, "user_id").select("event_id", "c_name"), streams.shared_folder(spark))
