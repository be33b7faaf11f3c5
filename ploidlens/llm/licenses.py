"""License scan by an exact set-similarity join of text blocks with license templates. DataFrame functions only.

Words are runs of ASCII digits and letters and of all other characters from U+0080 on, A-Z lowered.
Base: places where the words of a PHRASE stand one after the other.

The method: a block matches a template if at least THRESHOLD percent of the template's distinct words are in
it. Blocks are lines, for all templates, and for longer templates, which are often wrapped, also overlapping
runs of lines (RUNS). Spark counts in how many lines each template word occurs, over all documents;
words are ordered by that, rarest first. The join is on the first words of a template only (prefix
filter: of |T| words, need = ceil(t |T|) must be in the block, so one of the first |T| - need + 1 is).
Blocks with fewer template words than need are no candidates (length filter), nor are those whose first common
word leaves too few words after it in the block's own order (positional filter); the rest are verified.

All that grows with the data is keyed by block or document (two 64-bit hashes of id and text); the template side
has a fixed size. Null and empty texts: no words, no labels, score 0. Repeated rows and ids: labelled each. Empty
table: no rows. A very long line is one block. Extra columns are ignored. Ids must be whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ploidlens.llm import common as C

THRESHOLD = 85
#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Labels of the method, and the notices that stand for them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]
#: Blocks of several lines: how many, from each how many-th line on, and distinct words of the templates they are for.
RUNS = [(8, 4, 12), (64, 32, 40)]
#: Runs of characters between words, in lowered text.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    """The text with A-Z lowered. lower() also changes other letters, but no word to another ASCII word: U+212A, which would become k, is replaced first."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("κ")))


def template_words() -> list[tuple[int, str, list[str]]]:
    out = []
    for k, (label, text) in enumerate(TEMPLATES):
        plain = "".join(c if c.isalnum() else " " for c in text.lower())
        out.append((k, label, sorted(set(plain.split()))))
    return out


def _places(w, phrase: str):
    p = phrase.split()
    n = F.size(w) - len(p)

    def here(i):
        hit = F.get(w, i) == p[0]
        for k, x in enumerate(p[1:], 1):
            hit = hit & (F.get(w, i + k) == x)
        return hit

    return F.when(n >= 0, F.filter(F.sequence(F.lit(0), n), here)).otherwise(F.array().cast("array<int>"))


def vocabulary() -> list[str]:
    return sorted({w for _, _, ws in template_words() for w in ws})


def lines(rows: DataFrame) -> DataFrame:
    """Of rows (id, key, low): id, key, n_words, and for each line the distinct template words in it; staged."""
    words = F.filter(F.split("low", BREAK), lambda x: x != "")
    mine = vocabulary()
    have = F.transform(F.split("low", "\n"), lambda x: F.array_distinct(F.filter(F.split(x, BREAK), lambda w: w.isin(mine))))
    return C.staged(rows.select("id", "key", F.size(words).cast("long").alias("n_words"), have.alias("lines")), "lines")


def matches(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Of rows (key, lines): key, label, similarity of each template that a block matches."""
    spark, t = rows.sparkSession, template_words()
    counted = rows.select(F.explode(F.flatten("lines")).alias("word")).groupBy("word").count()
    often = dict.fromkeys(vocabulary(), 0) | {r["word"]: r["count"] for r in counted.collect()}  # as many as template words at most
    rank = {w: k for k, w in enumerate(sorted(often, key=lambda w: (often[w], w)))}
    place = F.create_map(*[F.lit(x) for w, k in rank.items() for x in (w, k)])
    side = []
    for k, label, ws in t:
        order = sorted(rank[w] for w in ws)
        need = _need(len(ws), threshold)
        side += [(label, len(ws), need, order, first) for first in order[: len(ws) - need + 1]]
    prefix = spark.createDataFrame(side, "label string, total int, need int, all array<int>, first int")
    sets = [F.transform("lines", lambda x: F.struct(F.lit(0).alias("least"), x.alias("w")))]
    for size, step, least in RUNS:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / step).cast("int")), lambda i: F.struct(F.lit(least).alias("least"), F.array_distinct(F.flatten(F.slice("lines", i * step + 1, size))).alias("w")))
        sets.append(F.when(F.size("lines") > 1, runs).otherwise(F.array().cast("array<struct<least:int,w:array<string>>>")))
    fewest = min(_need(len(ws), threshold) for _, _, ws in t)
    wide = F.filter(F.concat(*sets), lambda b: F.size(b.w) >= F.greatest(F.lit(fewest), F.ceil(b.least * threshold / 100)))
    blocks = rows.select("key", F.explode(wide).alias("b")).select("key", "b.least", F.array_sort(F.transform("b.w", lambda x: F.element_at(place, x))).alias("have"))
    hit = blocks.select("key", "least", "have", F.posexplode("have").alias("at", "first")).join(F.broadcast(prefix), "first")  # as many rows as template words at most
    hit = hit.filter((F.col("total") >= F.col("least")) & (F.size("have") - F.col("at") >= F.col("need")))  # the length filter is this one's at the first place
    hit = hit.filter(~F.arrays_overlap(F.slice("have", 1, F.col("at")), "all"))  # by the first common word, so once
    common = F.size(F.array_intersect("have", "all"))
    return hit.filter(common >= F.col("need")).select("key", "label", (common / F.col("total")).alias("similarity"))


def _need(total: int, threshold: int) -> int:
    return -(-threshold * total // 100)


def base_places(docs: DataFrame) -> DataFrame:
    """Of rows (key, low) with a base phrase: key, n_base, first_word, last_word, b (labels)."""
    rare = [max(p.split(), key=len) for p in PHRASES]
    rows = docs.filter(" or ".join(f"contains(low, '{x}')" for x in dict.fromkeys(rare)))
    rows = rows.select("key", F.explode(F.array(F.filter(F.split("low", BREAK), lambda x: x != ""))).alias("w"))  # one row each; it keeps the words from being computed anew for each place
    rows = rows.select("key", F.array(*[_places(F.col("w"), p) for p in PHRASES]).alias("found")).withColumn("flat", F.flatten("found")).filter("size(flat) > 0").dropDuplicates(["key"])
    names = F.array(*[F.when(F.size(F.col("found")[k]) > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())])
    return rows.select("key", F.size("flat").cast("long").alias("n_base"), F.array_min("flat").cast("long").alias("first_word"), F.array_max("flat").cast("long").alias("last_word"), F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))).alias("b"))


def scan(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", F.struct(F.xxhash64("id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "id").alias("b")).alias("key"), lowered(F.col("text")).alias("low"))
    found = lines(rows)
    own = matches(found.select("key", "lines"), threshold).groupBy("key").agg(F.collect_set("label").alias("m"), F.max("similarity").alias("similarity"))
    out = found.select("id", "key", "n_words").join(base_places(rows), "key", "left").join(own, "key", "left")
    none = F.array().cast("array<string>")
    b, n_base = F.coalesce("b", none), F.coalesce("n_base", F.lit(0)).cast("long")
    labels = F.array_sort(F.array_union(b, F.coalesce("m", none)))
    return out.select(F.col("id").alias(id_col), "n_words", n_base.alias("n_base"), "first_word", "last_word", F.array_join(b, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.when(n_base > 0, 1.0).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("score"))


def oracle() -> str:
    low = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sep = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    cut = "list_filter(regexp_split_to_array(" + low + f", '{sep}'), lambda x: x <> '')"
    places = " || ".join(f"list_transform(list_filter(range(0, len(w) - {len(p.split()) - 1}), lambda i: {' AND '.join(f'w[i + {k + 1}] = {x!r}' for k, x in enumerate(p.split()))}), lambda i: {{'p': i, 'l': {label!r}}})" for p, label in PHRASES.items())
    side = " UNION ALL ".join(f"SELECT {label!r} AS label, {ws!r} AS ws" for _, label, ws in template_words())
    runs = "".join(f" UNION ALL SELECT r, {least} AS least, {cut.format(f"array_to_string(ls[i * {step} + 1 : i * {step} + {size}], ' ')")} AS w FROM (SELECT r, ls, unnest(range(0, 1 + (len(ls) - 1) // {step})) AS i FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d) WHERE len(ls) > 1)" for size, step, least in RUNS)
    return f"""
WITH d AS (SELECT rowid AS r, doc_id, {cut.format("text")} AS w, text FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
f AS (SELECT r, doc_id, len(w) AS n_words, {places} AS f FROM d),
t AS ({side}),
b AS (SELECT r, 0 AS least, {cut.format("line")} AS w FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d){runs}),
m AS (SELECT r, label, len(list_intersect(w, ws)) AS n, len(ws) AS total FROM b JOIN t ON len(ws) >= least),
k AS (SELECT r, list(DISTINCT label) AS ls, max(n / total) AS s FROM m WHERE n >= ceil({THRESHOLD} * total / 100) GROUP BY r)
SELECT doc_id, n_words, CAST(len(f) AS BIGINT) AS n_base, CAST(list_min(list_transform(f, lambda x: x.p)) AS BIGINT) AS first_word, CAST(list_max(list_transform(f, lambda x: x.p)) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(f, lambda x: x.l))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(f, lambda x: x.l), coalesce(ls, [])))), ',') AS labels,
  CAST(CASE WHEN len(f) > 0 THEN 1 ELSE coalesce(s, 0) END AS DOUBLE) AS score
FROM f LEFT JOIN k USING (r)
"""


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(C.documents(spark, sf_dir))
