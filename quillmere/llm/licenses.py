"""License scans by an exact set-similarity join, in DataFrame functions alone.

Base: places where a phrase's words stand one after another. Method: a template is a license statement or a whole license, of n distinct words; it
belongs to the block size (a power of 2) that is twice its length or more. Blocks of a size start at every multiple of half of it, over the words of the
whole text, whatever its lines, so that any stretch as long as the template lies in a block. A template's label holds if some block contains
`THRESHOLD` or more of its distinct words, and the words that tell it from its kin. Words are ordered by how many documents hold them, over all
documents. Of a template of which t words are needed, any such block holds one of the n - t + 1 rarest: blocks meet templates on those prefix words.
The length filter then asks for t known words in the block; the positional filter for t matches at most: where the prefix word is the i-th of
the template and the j-th of the block's known words (from 0, in that order, of m), there are no more than min(i, j) before it and min(n - i, m - j) from it on.
What is left is verified word for word.

Templates are a parameter, a few hundred texts at most (`TEMPLATE_BYTES` is checked before they are broadcast). Only texts that hold some prefix
word are opened up into words, and only words of templates leave the scan, in one shuffle by text.

Defined results: null or empty text: no words, no labels, score 0. Null doc_id: kept. Repeated rows: a row each. Empty table: no rows. Very long texts:
blocks are bounded by their size, not by the text. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.batches import documents

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # for the SQL form; here texts are cut at what is between
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Base phrases and labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: License statements and notices with their labels, and the words that a block must hold whatever its share.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache"),
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "sublicense"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "gnu general"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "affero"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc sa"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike license", "noncommercial sharealike"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "fee disclaims"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "alter"),
    ("no-warranty", "the software is provided as is without warranty of any kind express or implied", "warranty"),
    ("public-domain", "this is free and unencumbered software released into the public domain", "domain"),
)
THRESHOLD = 0.8
TEMPLATE_BYTES = 16_000_000
LEAST_BLOCK = 16


def needed(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def block_size(words: int) -> int:
    return max(LEAST_BLOCK, 1 << (2 * words - 1).bit_length())


def checked(templates) -> list[tuple[str, str, str]]:
    """(label, text, words that a block must hold) of a list, or of a DataFrame (label, text, must) once its size is known to be small."""
    if isinstance(templates, DataFrame):
        size = templates.agg(F.coalesce(F.sum(F.length(F.col("text").cast("binary"))), F.lit(0))).first()[0]
        if size > TEMPLATE_BYTES:
            raise ValueError(f"{size} bytes of templates; {TEMPLATE_BYTES} may be broadcast")
        templates = sorted((r.label, r.text, r.must or "") for r in templates.select("label", "text", "must").dropna(subset=["label", "text"]).collect())
    return [(label, text, must) for label, text, must in templates if text.split()]


def token_counts(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each token of the templates stands: a row per token at most."""
    found = words.select(F.explode(F.array_intersect("words", F.lit(vocabulary))).alias("token")).groupBy("token").count()
    return {r.token: r["count"] for r in found.collect()}


class Index:
    """The templates' tokens in the global order, and the tables that words and blocks meet."""

    def __init__(self, spark: SparkSession, templates: list[tuple[str, str, str]], counts: dict[str, int], threshold: float):
        self.rank = {t: k for k, t in enumerate(sorted({w for _, s, must in templates for w in (*s.split(), *must.split())}, key=lambda t: (counts.get(t, 0), t)))}
        sizes: dict[str, set[int]] = {}
        rows = []
        for label, text, must in templates:
            own, size = sorted({self.rank[w] for w in text.split()}), block_size(len(text.split()))
            need, musts = needed(len(own), threshold), sorted({self.rank[w] for w in must.split()})
            for w in (*text.split(), *must.split()):
                sizes.setdefault(w, set()).add(size)
            rows += [(size, own[p], p, label, own, musts, need) for p in range(len(own) - need + 1)]
        self.prefixes = sorted({r[1] for r in rows})
        known = [(w, self.rank[w], sorted(s)) for w, s in sizes.items()]
        names = {k: w for w, k in self.rank.items()}
        self.prefix_words = sorted(names[k] for k in self.prefixes)
        self.words = F.broadcast(spark.createDataFrame(known, "token string, rank int, sizes array<int>").coalesce(1))
        self.templates = F.broadcast(spark.createDataFrame(rows, "size int, prefix int, place int, label string, tokens array<int>, musts array<int>, need int").coalesce(1))


def folded(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)


def words_of(low: Column | str) -> Column:
    """Cutting between the words costs half of matching them."""
    return F.array_remove(F.split(low, f"{BETWEEN}+"), "")


def places(phrase: str) -> Column:
    """Where the phrase's words stand in `words`, from 0; only looked for in texts that show them."""
    words = phrase.split()
    seen = F.rlike("low", F.lit(f"{BETWEEN}+".join(words)))
    k = F.sequence(F.lit(0), F.size("words") - len(words))
    own = F.filter(k, lambda i: F.reduce(F.array(*[F.element_at("words", i + j + 1) == w for j, w in enumerate(words)]), F.lit(True), lambda a, b: a & b))
    return F.when(seen & (F.size("words") >= len(words)), own).otherwise(F.array().cast("array<int>"))


def met(rows: DataFrame, index: Index) -> DataFrame:
    """From (row, head, words; none of texts without a prefix word): a row for each block and template that share a prefix word, with what
    the filters say, and at least one for each text. head stands in one row of each text."""
    each = rows.select("row", "head", F.posexplode_outer("words").alias("at", "token")).join(index.words, "token", "left")
    lead = F.coalesce(F.col("at") == 0, F.lit(True))
    each = each.filter(lead | F.col("rank").isNotNull()).select("row", F.when(lead, F.col("head")).alias("head"), "at", "rank", "sizes").repartition("row")
    in_block = lambda z: F.filter(F.array(F.col("at").cast("long") * 2 / z, F.col("at").cast("long") * 2 / z - 1), lambda k: k > -1)
    blocks = F.flatten(F.transform(F.coalesce("sizes", F.array().cast("array<int>")), lambda z: F.transform(in_block(z), lambda k: F.struct(z.alias("size"), F.floor(k).alias("block")))))
    every = F.when(F.col("head").isNotNull(), F.array(F.struct(F.lit(0).alias("size"), F.lit(0).cast("long").alias("block")))).otherwise(F.array().cast("array<struct<size:int,block:bigint>>"))
    spread = each.select("row", "head", "rank", F.explode(F.concat(every, blocks)).alias("b")).select("row", F.when(F.col("b.size") == 0, F.col("head")).alias("head"), "b.size", "b.block", F.when(F.col("b.size") > 0, F.col("rank")).alias("rank"))
    block = spread.groupBy("row", "size", "block").agg(F.first("head", ignorenulls=True).alias("head"), F.sort_array(F.collect_set("rank")).alias("known"))
    pairs = block.select("*", F.explode_outer(F.array_intersect("known", F.lit(index.prefixes))).alias("prefix")).join(index.templates, ["size", "prefix"], "left")
    n, m, i = F.size("tokens"), F.size("known"), F.col("place")
    j = F.array_position("known", F.col("prefix")) - 1
    return pairs.withColumns({"length_ok": m >= F.col("need"), "position_ok": F.least(i, j) + F.least(n - i, m - j) >= F.col("need")})


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    templates = checked(templates)
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), folded("text").alias("low"))
    words = low.withColumn("words", words_of("low"))
    vocabulary = sorted({w for _, s, must in templates for w in (*s.split(), *must.split())})
    index = Index(docs.sparkSession, templates, token_counts(words, vocabulary), threshold)
    based = words.withColumns({f"at{k}": places(p) for k, (p, _) in enumerate(PHRASES)})
    every = F.concat(*[f"at{k}" for k in range(len(PHRASES))])
    base = F.array_compact(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    head = F.struct("doc_id", F.size("words").cast("bigint").alias("n_words"), F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"), base.alias("base"))
    rows = based.select(F.monotonically_increasing_id().alias("row"), head.alias("head"), F.when(F.arrays_overlap("words", F.lit(index.prefix_words)), F.col("words")).alias("words"))
    near = met(rows, index)
    share = F.when(F.col("length_ok") & F.col("position_ok"), F.size(F.array_intersect("known", "tokens")) / F.size("tokens"))
    passes = (share * F.size("tokens") >= F.col("need") - 1e-9) & (F.size(F.array_except("musts", "known")) == 0)
    found = near.select("row", "head", F.when(passes, F.col("label")).alias("label"), F.when(passes, share).alias("share"))
    done = found.groupBy("row").agg(F.first("head", ignorenulls=True).alias("head"), F.collect_set("label").alias("more"), F.max("share").alias("score")).select("head.*", "more", "score")
    tell = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return done.select("doc_id", "n_words", "n_base", "first_word", "last_word", tell("base").alias("base_labels"), tell(F.concat("base", "more")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows in DuckDB: every block against every template."""
    listed = lambda words: f"CAST({sorted(set(words.split()))} AS VARCHAR[])"
    rows = ", ".join(f"('{label}', {block_size(len(s.split()))}, {listed(s)}, {listed(must)}, {needed(len(set(s.split())), threshold)})" for label, s, must in templates)
    phrase = lambda p: f"list_filter(range(len(words) - {len(p.split()) - 1}), lambda i: " + " AND ".join(f"words[i + {j + 1}] = '{w}'" for j, w in enumerate(p.split())) + ")"
    return f"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT r, doc_id, low, regexp_extract_all(low, '{WORD}') AS words FROM low),
b AS (SELECT r, doc_id, len(words) AS n_words, {", ".join(f"{phrase(p)} AS at{k}" for k, (p, _) in enumerate(PHRASES))} FROM w),
t(label, size, tokens, must, need) AS (VALUES {rows}),
blocks AS (SELECT r, size, words[k * (size // 2) + 1 : k * (size // 2) + size] AS block FROM w, (SELECT DISTINCT size FROM t), unnest(range((len(words) + size // 2 - 1) // (size // 2))) AS u(k)),
hit AS (SELECT r, label, len(list_intersect(tokens, block)) / len(tokens) AS share FROM blocks JOIN t USING (size) WHERE len(list_intersect(tokens, block)) >= need AND list_has_all(block, must)),
more AS (SELECT r, list(DISTINCT label) AS more, max(share) AS score FROM hit GROUP BY r),
j AS (SELECT b.*, list_concat(at0, list_concat(at1, at2)) AS every, list_filter([{", ".join(f"CASE WHEN len(at{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))}], lambda s: s IS NOT NULL) AS base, coalesce(more, []) AS more, coalesce(score, 0.0) AS score FROM b LEFT JOIN more USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(list_min(every) AS BIGINT) AS first_word, CAST(list_max(every) AS BIGINT) AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, more))), ',') AS labels, CAST(score AS DOUBLE) AS score FROM j"""
