"""License scans: an exact set-similarity join of text blocks and templates.

A template is a license statement or a whole license text; a block is a window
of consecutive words, whatever lines they stand on. Templates go by length:
one of up to ``s / 2`` words, for the smallest s of ``SCALES`` that allows it,
is held against windows of s words, which begin every ``s / 2`` words, so that
each run of words as long as the template lies wholly within one. Both are
sets of words. A block meets a template if it contains at least ``CONTAINED``
of its words. The template words are counted over all documents and put in
order, rarest first (ties by word). Then

* prefix filter: with n words and k needed, one of the template's first
  n - k + 1 words must be in the block, so only blocks with such a word are
  looked at, and they meet the templates in an equi-join on that word;
* length filter: a block needs k template words at all;
* positional filter: from a shared word on, the words that follow it on
  either side must suffice for k;
* what is left is verified by intersection.

Everything is DataFrame functions. Templates, and so the prefix index, are a
fixed list; the counts that reach the driver are one for each template word.
Beside the join, phrases are found at their places in the word sequence.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, prepare, read, whole

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
CONTAINED = 0.8
SCALES = (32, 128, 512)

#: Phrases and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: License statements and texts and their labels (fixed values).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose is hereby granted"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license "
        "is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
]


def words(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    return F.filter(F.split(lower_ascii(text), GAP + "+"), lambda w: w != "")


def scale_of(template: str) -> int:
    """The length of the windows that a template is held against."""
    n = len(template.split())
    return next((s for s in SCALES if 2 * n <= s), 2 * n)


def holds(text: Column, some: list[str]) -> Column:
    """Whether one of ``some`` stands anywhere in a text; not less than what the words say."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in some])


def frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """How often each of ``vocabulary`` occurs in all texts."""
    found = docs.select(F.explode(F.split(F.lower(text_col), GAP + "+")).alias("w")).where(F.col("w").isin(vocabulary))
    rows = found.groupBy("w").agg(F.count("*").alias("n")).collect()  # one for each word of the vocabulary
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["n"] for r in rows}


def similar_blocks(docs: DataFrame, templates: list[tuple[str, str]] | None = None, contained: float = CONTAINED, text_col: str = "text", key_col: str = "key") -> DataFrame:
    """``(key, scale int, first int, label, containment double)`` of every block that meets a template.

    A block has ``scale`` words from the word ``first`` on, fewer at the end.
    Rows that share a key give their blocks once for each row. Null and empty
    texts have no blocks.
    """
    spark, templates = docs.sparkSession, TEMPLATES if templates is None else templates
    prepare(spark)
    sets = [(label, scale_of(text), sorted(set(text.split()))) for label, text in templates]
    vocabulary = sorted({w for _, _, s in sets for w in s})
    counts = frequencies(docs, vocabulary, text_col)
    order = sorted(vocabulary, key=lambda w: (counts[w], w))
    rank = {w: i for i, w in enumerate(order)}
    index, prefix = [], set()
    for no, (label, scale, s) in enumerate(sets):
        ranks = sorted(rank[w] for w in s)
        need = math.ceil(contained * len(ranks) - 1e-9)
        for i in range(len(ranks) - need + 1):
            index.append((no, label, scale, ranks[i], i, len(ranks), need, ranks))
            prefix.add(order[ranks[i]])
    index = spark.createDataFrame(index, "no int, label string, scale int, rank int, i int, n int, need int, ranks array<int>")
    rare = sorted(prefix)
    text = F.col(text_col)
    found = docs.where(holds(text, rare)).select(key_col, words(text).alias("w")).where(F.arrays_overlap("w", F.array(*map(F.lit, rare))))
    size = F.col("scale")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - (size / 2).cast("int") - 1), (size / 2).cast("int"))
    blocks = found.select("*", F.explode(F.array(*[F.lit(s) for s in sorted({s for _, s, _ in sets})])).alias("scale"))
    blocks = blocks.select(key_col, "scale", "w", F.explode(starts).alias("first")).select(key_col, "scale", "first", F.slice("w", F.col("first") + 1, size).alias("w"))
    blocks = blocks.where(F.arrays_overlap("w", F.array(*map(F.lit, rare))))
    ranks = F.create_map(*[F.lit(x) for w in order for x in (w, rank[w])])
    blocks = blocks.select(key_col, "scale", "first", F.array_sort(F.array_distinct(F.filter(F.transform("w", lambda w: ranks[w]), lambda r: r.isNotNull()))).alias("b"))
    pairs = blocks.select("*", F.posexplode("b").alias("j", "rank")).join(F.broadcast(index), ["rank", "scale"])
    pairs = pairs.where((F.size("b") >= F.col("need")) & (F.least(F.col("n") - F.col("i"), F.size("b") - F.col("j")) >= F.col("need")))
    shared = F.size(F.array_intersect("b", "ranks"))
    met = pairs.withColumn("shared", shared).where("shared >= need")
    return met.groupBy(key_col, "scale", "first", "label").agg(F.max(F.col("shared") / F.col("n")).alias("containment"))


def phrase_places(w: str) -> Column:
    """``array<struct<at int, label string>>`` of the phrases in the words ``w``."""

    def starts(phrase: str, label: str) -> Column:
        parts = phrase.split()
        here = lambda i: reduce(lambda a, b: a & b, [F.get(F.col(w), i + k) == p for k, p in enumerate(parts)])
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    return F.concat(*[starts(p, label) for p, label in PHRASES.items()])


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, contained: float = CONTAINED, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with what the scan found.

    Adds ``n_words, n_base, first_word, last_word, base_labels, labels,
    score``; columns of these names are replaced. A null text is empty: no
    words, no labels, score 0. Rows with equal texts have equal results.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    text = F.col("text")
    keyed = docs.select(whole(docs, text_col, *new), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5(text.cast("binary"))))
    met = similar_blocks(keyed.select("key", "text"), templates, contained)
    met = met.groupBy("key").agg(F.collect_set("label").alias("met"), F.max("containment").alias("best"))
    phrase = "(?i)(?<!{0})(?:{1})(?!{0})".format(LETTER, "|".join((GAP + "+").join(p.split()) for p in PHRASES))
    rows = keyed.withColumn("n_words", F.regexp_count(text, F.lit(LETTER + "++")).cast("long"))
    last = sorted({p.split()[-1] for p in PHRASES})  # cheap to look for, and part of every phrase
    rows = rows.withColumn("w", F.when(holds(text, last) & text.rlike(phrase), words(text)))
    rows = rows.withColumn("at", F.when(F.col("w").isNotNull() & (F.size("w") > 0), phrase_places("w"))).drop("w", "text")
    none = F.array().cast("array<string>")
    rows = rows.select(
        "row",
        "key",
        "n_words",
        F.coalesce(F.when(F.col("at").isNotNull(), F.size("at")), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("at.at").cast("long").alias("first_word"),
        F.array_max("at.at").cast("long").alias("last_word"),
        F.coalesce(F.array_distinct("at.label"), none).alias("base"),
    )
    rows = rows.join(met, "key", "left")
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return rows.select("row.*", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(F.concat("base", F.coalesce("met", none))).alias("labels"), score.alias("score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    places = " UNION ALL ".join(
        f"SELECT rid, '{label}' AS label, unnest(list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i+{k + 1}] = '{p}'" for k, p in enumerate(phrase.split())) + ")) AS i FROM d"
        for phrase, label in PHRASES.items()
    )
    templates = ", ".join(f"('{label}', {scale_of(text)}, {sorted(set(text.split()))!r}, {math.ceil(CONTAINED * len(set(text.split())) - 1e-9)})" for label, text in TEMPLATES)
    scales = ", ".join(f"({s})" for s in sorted({scale_of(text) for _, text in TEMPLATES}))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, t, regexp_extract_all(t, '{word}') AS w FROM (SELECT doc_id, {low} AS t FROM documents)),
p AS ({places}),
pb AS (SELECT rid, count(*) AS n, min(i) AS a, max(i) AS b, list_distinct(list(label)) AS l FROM p GROUP BY rid),
t(label, scale, s, need) AS (VALUES {templates}),
sc(scale) AS (VALUES {scales}),
b AS (SELECT rid, scale, list_distinct(w[i + 1 : i + scale]) AS s FROM (
  SELECT rid, scale, w, unnest(range(0, greatest(0, len(w) - scale // 2 - 1) + 1, scale // 2)) AS i FROM d, sc)),
m AS (SELECT rid, label, len(list_intersect(b.s, t.s)) / len(t.s) AS c FROM b JOIN t USING (scale) WHERE len(list_intersect(b.s, t.s)) >= need),
mb AS (SELECT rid, list_distinct(list(label)) AS l, max(c) AS c FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(pb.n, 0)::BIGINT AS n_base, pb.a::BIGINT AS first_word, pb.b::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(pb.l, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(pb.l, []), coalesce(mb.l, [])))), ',') AS labels,
  greatest(coalesce(mb.c, 0.0), CASE WHEN pb.n > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN pb USING (rid) LEFT JOIN mb USING (rid)
"""


OP7_SQL = _sql()
