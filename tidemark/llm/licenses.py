"""License scan by DataFrame functions alone: listed phrases, and an exact set-similarity join of text blocks with templates.

A block is a window of WIDTH words at every STEP words of a text, whatever lines they stand on, as the set of its words, so
every notice of up to STEP + 1 words lies in one whole; a template is a set of words with a label. The join finds every pair
in which the block holds at least ``threshold`` of the template's words. Words are ordered by the number of texts that hold
them, rarest first, counted over all documents; words that no template has cannot add to an overlap and need no place in
that order. A text without enough of them has no blocks to look at. With o = ceil(threshold * template size):
  prefix filter      a pair shares one of the first size - o + 1 words of the template,
  length filter      the block has at least o words,
  positional filter  after the first shared prefix word, at most 1 + min(template words, block words) still to come can
                     be shared, and that must reach o.
What passes is verified by intersection. The templates are a fixed list, which bounds what is broadcast.

A null text is empty: no words, no labels, score 0. Rows that repeat a document get the same result each. Extra columns of
``docs`` are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import _shared

#: Fixed values of the task.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Label and words of each template, of at most STEP + 1 words.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("reserved", "all rights reserved"),
]
#: Words of a block, and from one block's start to the next.
WIDTH, STEP = 64, 32
THRESHOLD = 0.8
#: The ASCII characters that are not digits or letters.
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _half_spaces(c: Column) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / 2).cast("long")


def phrases(text: Column, listed: list[tuple[str, str]]) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and the array base_labels; every word stands between two spaces of its own."""
    bare = F.trim(F.regexp_replace(_lowered(text), _BREAK, "  "))
    spaced = F.when(bare == "", "").otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))
    return {"spaced": spaced}


def _found(listed: list[tuple[str, str]]) -> list[Column]:
    s = F.col("spaced")
    n_words, counts, firsts, lasts, labels = F.col("n_words"), [], [], [], []
    for phrase, label in listed:
        own = phrase.split()
        needle = " " + "  ".join(own) + " "
        there = s.contains(needle)
        bare = F.length(F.replace(s, F.lit(needle), F.lit("")))
        counts.append(F.when(there, ((F.length(s) - bare) / len(needle)).cast("long")).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(there, _half_spaces(F.substring_index(s, needle, 1))))
        lasts.append(F.when(there, n_words - _half_spaces(F.substring_index(s, needle, -1)) - len(own)))
        labels.append(F.when(there, F.lit(label)))
    return [
        reduce(lambda a, b: a + b, counts).alias("n_base"),
        (F.least(*firsts) if len(firsts) > 1 else firsts[0]).alias("first_word"),
        (F.greatest(*lasts) if len(lasts) > 1 else lasts[0]).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base_set"),
    ]


def _worded(docs: DataFrame, known: list[str]) -> DataFrame:
    """doc_id, key, the words of each text in order, and which of the ``known`` words it holds."""
    words = F.split(F.trim(F.regexp_replace(_lowered(F.col("text").cast("string")), _BREAK, " ")), " ")
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), words.alias("all"))
    return rows.withColumn("has", F.array_intersect("all", F.array(*map(F.lit, known))))


def matches(docs: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """doc_id, key, label, containment of every (block, template) pair that meets the threshold."""
    spark = docs.sparkSession
    known = sorted({w for _, t in templates for w in t.split()})
    texts = _worded(docs, known)
    counted = texts.select(F.explode("has").alias("word")).groupBy("word").count().collect()  # a row for each template word at most
    often = {r["word"]: r["count"] for r in counted}
    order = {w: i for i, w in enumerate(sorted(known, key=lambda w: (often.get(w, 0), w)))}
    index = []
    for number, (label, text) in enumerate(templates):
        own = sorted(set(text.split()), key=order.get)
        need = math.ceil(threshold * len(own) - 1e-9)
        index += [(w, number, label, place, len(own), need, own) for place, w in enumerate(own[: len(own) - need + 1])]
    prefixes = spark.createDataFrame(index, "word string, template int, label string, place int, size int, need int, own array<string>")
    least = min(r[5] for r in index)
    first = F.array(*map(F.lit, sorted({r[0] for r in index})))
    rank = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))])
    near = texts.where((F.size("has") >= least) & F.arrays_overlap("has", first))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - STEP), F.lit(STEP))
    held = near.select("doc_id", "key", F.explode(F.transform(starts, lambda i: F.slice("all", i, WIDTH))).alias("block"))
    held = held.select("doc_id", "key", F.array_distinct("block").alias("words")).withColumn("shared", F.array_intersect("words", F.array(*map(F.lit, known))))
    narrow = held.where((F.size("shared") >= least) & F.arrays_overlap("shared", first))
    narrow = narrow.withColumn("later", F.array_sort(F.transform("shared", lambda w: rank[w])))
    pairs = narrow.withColumn("word", F.explode(F.array_intersect("shared", first))).join(F.broadcast(prefixes), "word")
    ahead = F.size(F.filter("later", lambda r: r > rank[F.col("word")]))
    pairs = pairs.where((F.size("words") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("place") - 1, ahead) + F.col("place") >= F.col("need")))
    overlap = F.size(F.array_intersect("shared", "own"))
    return pairs.where(overlap >= F.col("need")).select("doc_id", "key", "label", (overlap / F.col("size")).alias("containment"))


def scan(docs: DataFrame, listed: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: phrase places, labels of phrases and of templates, and the best containment (1 with a phrase)."""
    best = matches(docs, templates, threshold).groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("label")).alias("found"), F.max("containment").alias("best"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), phrases(F.col("text").cast("string"), listed)["spaced"].alias("spaced"))
    rows = rows.withColumn("n_words", _half_spaces(F.col("spaced"))).select("doc_id", "key", "n_words", *_found(listed))
    best = best.withColumnsRenamed({"doc_id": "own_id", "key": "own_key"})
    both = rows.join(best, rows["doc_id"].eqNullSafe(best["own_id"]) & (rows["key"] == best["own_key"]), "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_set", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_set", found)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_shared.read(spark, sf_dir, "documents"))


def _sql() -> str:
    listed = ", ".join(f"({p.split()}, '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"({sorted(set(t.split()))}, '{label}')" for label, t in TEMPLATES)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return rf"""
WITH phrase(own, label) AS (VALUES {listed}),
template(own, label) AS (VALUES {templates}),
doc AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
worded AS (SELECT r, doc_id, regexp_extract_all(t, '{word}') AS w FROM doc),
place AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(own)] = own)) AS spot FROM worded, phrase
  WHERE list_contains(w, own[1])),
base AS (SELECT r, count(*) AS n, min(spot) AS a, max(spot) AS b, list(DISTINCT label) AS l FROM place GROUP BY r),
start AS (SELECT r, w AS v, unnest(range(0, greatest(len(w) - {STEP}, 1), {STEP})) AS i FROM worded),
block AS (SELECT r, list_slice(v, i + 1, i + {WIDTH}) AS w FROM start),
hit AS (SELECT r, label, len(list_intersect(list_distinct(w), own)) / len(own) AS c FROM block, template
  WHERE len(list_intersect(list_distinct(w), own)) >= ceil({THRESHOLD} * len(own) - 1e-9)),
best AS (SELECT r, max(c) AS c, list(DISTINCT label) AS l FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word,
  coalesce(array_to_string(list_sort(base.l), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(best.l, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.c, 0)::DOUBLE END AS score
FROM worded LEFT JOIN base USING (r) LEFT JOIN best USING (r)"""


SQL = _sql()
