"""Operator 3: license scans as an exact set-similarity join, in DataFrame functions only.

Blocks are all stretches of ``BLOCK`` words. A block matches a notice when it holds at least
``THRESHOLD`` of the notice's distinct words. Blocks that begin at a word of the notices stand for all
others: moving a block's start on to its first such word loses none of them. The join is exact and avoids comparing all with all:

* the notices' words are ordered by how often they occur in the whole corpus, rarest first;
* prefix filter: a matching block holds one of the first ``size - needed + 1`` words of the notice,
  so blocks meet notices by an equi-join on these rare words only (the notices are a fixed list,
  broadcast); texts that hold none of them are not cut into blocks at all;
* length filter: the block needs ``needed`` words of the notices' vocabulary;
* positional filter: with the first shared word at place i of the notice and j of the block, no
  more than the words from there on can be shared;
* what is left is verified by the size of the intersection.

Base phrases are counted beside it, as places where their words stand consecutively.

Defined results: null counts as empty; a text without words has zero counts, null places, empty
label lists and score 0; score is 1 with a base phrase, else the best share of a matching notice,
else 0. Every input row gives one output row, repeated ids and rows included.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices of well-known licenses and their labels.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

THRESHOLD = 0.9
BLOCK = 48
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normal_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, joined by single spaces."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.btrim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" "))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _base(norm: Column, n_words: Column) -> list[Column]:
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    count, first, last, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        held = F.contains(padded, F.lit(f" {phrase} "))
        count.append(F.when(held, F.regexp_count(padded, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        before = F.substring_index(padded, f" {phrase} ", 1)
        after = F.substring_index(padded, f" {phrase} ", -1)
        first.append(F.when(held, _spaces(before)))
        last.append(F.when(held, n_words - len(phrase.split()) - _spaces(after)))
        labels.append(F.when(held, F.lit(label)))
    total = count[0]
    for c in count[1:]:
        total = total + c
    return [total.cast("long").alias("n_base"), F.least(*first).cast("long").alias("first_word"),
            F.greatest(*last).cast("long").alias("last_word"), F.array_compact(F.array(*labels)).alias("_base")]


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest in the corpus first (ties by spelling); its size is fixed."""
    words = docs.select(F.explode(F.split(normal_words(F.col("text")), " ")).alias("word"))
    seen = dict(words.filter(F.col("word").isin(vocabulary)).groupBy("word").count().collect())
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text)`` to one row per document: n_words, n_base, first_word, last_word,
    base_labels, labels, score."""
    spark = docs.sparkSession
    order = word_order(docs, sorted({w for _, t in notices for w in t.split()}))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for i, (label, t) in enumerate(notices):
        words = sorted({rank[w] for w in t.split()})
        needed = math.ceil(threshold * len(words) - 1e-9)
        rows += [(w, i, label, words, needed, place) for place, w in enumerate(words[:len(words) - needed + 1])]
    prefix = spark.createDataFrame(rows, "rank int, notice int, label string, words array<int>, needed int, place int")
    rare = sorted({r[0] for r in rows})
    least = min(r[4] for r in rows)
    ranks = F.create_map(*[F.lit(x) for w in order for x in (w, rank[w])])

    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), normal_words(F.col("text")).alias("_norm"))
    texts = texts.select("doc_id", "_row", "_norm",
                         F.when(F.col("_norm") == "", 0).otherwise(_spaces(F.col("_norm")) + 1).cast("long").alias("n_words"),
                         F.split("_norm", " ").alias("_words"))
    texts = texts.select("doc_id", "_row", "n_words", *_base(F.col("_norm"), F.col("n_words")),
                         F.when(F.arrays_overlap("_words", F.array(*[F.lit(order[r]) for r in rare])), F.col("_words")).alias("_words"))
    # the notices' words in texts that hold a rare one; a stretch that matches can begin at its first such
    # word, and some rare word stands in it
    marks = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda m: m["w"].isin(order))
    texts = texts.withColumn("_marks", marks).withColumn(
        "_rare", F.transform(F.filter("_marks", lambda m: m["w"].isin([order[r] for r in rare])), lambda m: m["i"]))
    starts = F.filter(F.transform("_marks", lambda m, j: F.struct(j.alias("j"), m["i"].alias("i"))), lambda s: F.exists(
        "_rare", lambda q: (q >= s["i"]) & (q < s["i"] + BLOCK)))
    blocks = F.array_distinct(F.transform(starts, lambda s: F.array_sort(F.transform(F.array_distinct(F.transform(F.filter(
        F.slice("_marks", s["j"] + 1, BLOCK), lambda m: m["i"] < s["i"] + BLOCK), lambda m: m["w"])), lambda w: F.element_at(ranks, w)))))
    base = ["doc_id", "_row", "n_words", "n_base", "first_word", "last_word", "_base"]
    cut = texts.select(*base, F.explode_outer(F.when(
        F.col("_words").isNotNull(), F.filter(blocks, lambda b: F.size(b) >= least))).alias("_block"))
    met = cut.select(*base, "_block", F.explode_outer(F.array_intersect("_block", F.array(*[F.lit(r) for r in rare]))).alias("rank"))
    met = met.join(F.broadcast(prefix), "rank", "left")
    first_at = F.array_position("_block", F.col("rank")) - 1
    room = F.least(F.size("words") - F.col("place"), F.size("_block") - first_at)
    is_first = F.element_at(F.array_intersect("words", "_block"), 1) == F.col("rank")
    shared = F.size(F.array_intersect("words", "_block"))
    share = F.when(F.col("words").isNotNull() & (room >= F.col("needed")) & is_first & (shared >= F.col("needed")),
                   shared / F.size("words"))
    found = met.select(*base, "label", share.alias("_share")).groupBy("_row").agg(
        *[F.first(c).alias(c) for c in base if c != "_row"], F.max("_share").alias("_share"),
        F.collect_set(F.when(F.col("_share").isNotNull(), F.col("label"))).alias("_found"))
    def line(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", line(F.col("_base")).alias("base_labels"),
                        line(F.concat("_base", "_found")).alias("labels"),
                        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"))


def oracle_sql(notices: list[tuple[str, str]] = NOTICES, threshold: float = THRESHOLD) -> str:
    """The same result in DuckDB SQL: for each place of a word of a notice, the notice's words in the stretch from there."""
    def words(t: str) -> str:
        return "[" + ", ".join(f"'{w}'" for w in t.split()) + "]"

    phrases = ", ".join(f"({words(p)}, '{label}')" for p, label in PHRASES.items())
    listed = ", ".join(f"({words(' '.join(sorted(set(t.split()))))}, '{label}')" for label, t in notices)
    return f"""
WITH phrases(p, label) AS (VALUES {phrases}),
notices(t, label) AS (VALUES {listed}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
places AS (SELECT r, label, len(p) AS n, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS spot
           FROM docs, phrases WHERE list_has_all(w, p)),
base AS (SELECT r, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS b FROM places GROUP BY r),
words AS (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS word FROM docs),
listed AS (SELECT row_number() OVER () AS notice, label, len(t) AS n, t FROM notices),
marks AS (SELECT r, notice, label, n, i, word FROM words JOIN (SELECT notice, label, n, unnest(t) AS word FROM listed) USING (word)),
shares AS (SELECT a.r, a.label, a.n, count(DISTINCT b.word) / a.n AS s, count(DISTINCT b.word) AS k
           FROM marks a JOIN marks b ON a.r = b.r AND a.notice = b.notice AND b.i BETWEEN a.i AND a.i + {BLOCK} - 1
           GROUP BY a.r, a.notice, a.label, a.n, a.i),
found AS (SELECT r, max(s) AS s, list(DISTINCT label) AS f FROM shares WHERE k >= ceil({threshold} * n - 1e-9) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(b, []) || coalesce(f, []))), ',') AS labels,
  CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0 ELSE coalesce(s, 0.0) END::DOUBLE AS score
FROM docs LEFT JOIN base USING (r) LEFT JOIN found USING (r)
"""
