"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A text's words are cut into blocks: for templates of up to w words, every w-th word starts a block of 2w words, so a passage
as long as a template lies whole in a block. A block matches a template if it holds at least the share ``threshold`` of the template's distinct
words. The join is exact and filters in three ways. All words of templates are ordered by how many documents hold them, rare first. A
matching block must hold one of the template's first ``size - need + 1`` words in that order (prefix filter), which are the join
key; it must hold ``need`` words of templates at all (length filter); and where the two first meet, enough words must follow on both sides
(positional filter). A pair meets only at its first common word, so it is one row. What is left is counted exactly.

The base phrases are templates with threshold 1, whose matches are then looked up word for word, each place in the block that owns its start.

Templates are parameters, a literal table that is bounded by them and goes to every task; words and blocks of documents are never shuffled, only
matches and one small row a document. So hot words, copies and hot sources cost what other rows cost. Words are counted over all documents.

Defined cases: a null text is empty and has no words and no labels (empty strings, score 0, no places); repeated rows each get a
result; a null doc_id stays null; an empty table gives an empty result; other columns are not looked at, whatever their names. ``score`` is the
largest share of a template's words found in a block among matches, 1 if a base phrase is there, else 0.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import Scratch

#: What is a word, and the base phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The one letter beyond ASCII that lower() makes an ASCII letter of, and a stand-in that stays as it is.
KELVIN, STAND_IN = "\u212a", "\u0138"
THRESHOLD = 0.8
#: Words of the shortest blocks' stride.
LEAST_STRIDE = 16

#: Usual notices by label.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
    "version 3 of the License, or (at your option) any later version.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-release": "Released under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    threshold: float
    base: bool

    @property
    def distinct(self) -> tuple[str, ...]:
        return tuple(sorted(set(self.words)))

    @property
    def need(self) -> int:
        return math.ceil(round(self.threshold * len(self.distinct), 9))

    @property
    def stride(self) -> int:
        return max(LEAST_STRIDE, 1 << (len(self.words) - 1).bit_length())


def plain_words(text: str) -> tuple[str, ...]:
    return tuple(re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text)))


def templates(notices: dict[str, str] | None = None, threshold: float = THRESHOLD) -> list[Template]:
    own = [Template(k, plain_words(v), threshold, False) for k, v in (NOTICES if notices is None else notices).items()]
    return [Template(v, tuple(k.split()), 1.0, True) for k, v in BASE.items()] + own


def words(text: Column) -> Column:
    """Words of a text with A-Z lowered; letters beyond ASCII may be lowered too, which makes none of them an ASCII word."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(STAND_IN)))
    return F.array_remove(F.split(low, WORD.replace("[^", "[")), "")  # splitting between words is far cheaper than extracting them


def strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def blocks(stride: int, some: list[str]) -> Column:
    """(stride, at, words): where each block starts, and its words, of a column ``words``; those that hold one of ``some``."""
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(stride))
    cut = F.transform(starts, lambda at: F.struct(F.lit(stride).alias("stride"), at.alias("at"), F.slice("words", at + 1, 2 * stride).alias("words")))
    return F.filter(F.when(F.size("words") > 0, cut), lambda x: F.arrays_overlap(x.words, strings(some)))


def matches(docs: DataFrame, found: list[Template], order: dict[str, int]) -> DataFrame:
    """(key, at, label, base, share, places) of each block and template that match, of rows (key, words)."""
    ranked = [sorted(order[w] for w in t.distinct) for t in found]
    heads = [r[: len(r) - t.need + 1] for r, t in zip(ranked, found, strict=True)]
    word = {n: w for w, n in order.items()}
    post = [F.struct(F.lit(r).alias("r"), F.lit(t.stride).alias("stride"), F.lit(i).alias("i"), F.array(*map(F.lit, ranked[n])).alias("own"), F.lit(t.need).alias("need"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), strings(t.words).alias("phrase")) for n, t in enumerate(found) for i, r in enumerate(heads[n])]
    index = docs.sparkSession.range(1).select(F.inline(F.array(*post)))
    ranks = F.create_map(*(x for w, n in order.items() for x in (F.lit(w), F.lit(n))))
    strides = sorted({t.stride for t in found})
    some = {k: sorted({word[r] for h, t in zip(heads, found, strict=True) if t.stride == k for r in h}) for k in strides}
    d = docs.select("key", F.explode(F.concat(*(blocks(k, some[k]) for k in strides))).alias("x"))
    has = F.array_sort(F.transform(F.array_intersect("x.words", strings(list(order))), lambda w: F.element_at(ranks, w)))
    d = d.select("key", "x.stride", "x.at", "x.words", has.alias("has"))
    d = d.select("*", F.posexplode("has").alias("j", "r")).join(F.broadcast(index), ["stride", "r"])  # the index is as large as the templates
    n_own, n_has = F.size("own"), F.size("has")
    d = d.where((n_has >= F.col("need")) & (1 + F.least(n_own - 1 - F.col("i"), n_has - 1 - F.col("j")) >= F.col("need")))
    d = d.where(~F.arrays_overlap(F.slice("own", 1, F.col("i")), "has") | (F.col("i") == 0))
    d = d.withColumn("common", F.size(F.array_intersect("own", "has"))).where(F.col("common") >= F.col("need"))
    own_starts = F.sequence(F.lit(0), F.least("stride", F.size("words")) - 1)
    places = F.filter(own_starts, lambda s: F.slice("words", s + 1, F.size("phrase")) == F.col("phrase"))
    places = F.transform(F.when(F.col("base"), places).otherwise(F.array().cast("array<int>")), lambda s: (s + F.col("at")).cast("long"))
    return d.select("key", "at", "label", "base", (F.col("common") / n_own).alias("share"), places.alias("places"))


def scan(docs: DataFrame, found: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    found = templates() if found is None else found
    scratch = Scratch(docs.sparkSession, "licenses")
    key = F.concat_ws(":", F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    d = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), words(F.col(text_col)).alias("words"))
    vocabulary = sorted({w for t in found for w in t.distinct})
    rows = scratch.save("rows", d.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", strings(vocabulary)).alias("seen")))
    held = {r.w: r["count"] for r in rows.select(F.explode("seen").alias("w")).groupBy("w").count().collect()}  # a row for each word of the templates
    order = {w: n for n, w in enumerate(sorted(vocabulary, key=lambda w: (held.get(w, 0), w)))}
    hits = matches(d.select("key", "words"), found, order)
    there = ~F.col("base") | (F.size("places") > 0)
    hits = hits.where(there).groupBy("key", "at", "label", "base").agg(F.max("share").alias("share"), F.max("places").alias("places"))  # equal rows count once
    base = lambda c: F.when(F.col("base"), c)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = hits.groupBy("key").agg(F.sum(F.size("places")).alias("n_base"), F.min(base(F.array_min("places"))).alias("first_word"), F.max(base(F.array_max("places"))).alias("last_word"), joined(base(F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("share").alias("score"))
    per = scratch.save("found", per)
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return rows.join(per, "key", "left").select("doc_id", "n_words", none("n_base", 0).cast("long").alias("n_base"), "first_word", "last_word", none("base_labels", ""), none("labels", ""), none("score", 0.0))


def oracle(table: str = "documents", found: list[Template] | None = None) -> str:
    """The same in SQL: every block against every template, every place of a phrase."""
    found = templates() if found is None else found
    rows = ", ".join(f"('{t.label}', {list(t.distinct)}, {list(t.words)}, {t.need}, {t.stride}, {str(t.base).lower()})" for t in found)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t(label, toks, phrase, need, stride, base) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all({lower}, '{WORD}') AS ws FROM {table}),
w AS (SELECT rn, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d),
p AS (SELECT d.rn, t.label, i FROM w JOIN t ON t.base AND w.word = t.phrase[1] JOIN d ON d.rn = w.rn WHERE d.ws[i + 1:i + len(t.phrase)] = t.phrase),
b AS (SELECT rn, stride, unnest(range(0, len(ws), stride)) AS lo, ws FROM d, (SELECT DISTINCT stride FROM t WHERE NOT base)),
c AS (SELECT rn, stride, list_distinct(ws[lo + 1:lo + 2 * stride]) AS has FROM b),
m AS (SELECT rn, label, len(list_intersect(has, toks)) / len(toks) AS share FROM c JOIN t ON c.stride = t.stride AND NOT t.base WHERE len(list_intersect(has, toks)) >= need),
a AS (SELECT rn, label, 1.0 AS share, true AS base FROM p UNION ALL SELECT rn, label, share, false FROM m),
g AS (SELECT rn, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels FROM a GROUP BY rn),
q AS (SELECT rn, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM p GROUP BY rn)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (rn) LEFT JOIN q USING (rn)
"""
