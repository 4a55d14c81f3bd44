"""License scans: an exact set-similarity join of text blocks with license templates.

A block is what stands between line breaks or sentence ends (``.``, ``!`` or ``?`` before white
space), or a window of as many consecutive words of the whole text as the template has, divided by
``threshold`` and rounded up: line breaks and full stops do not cut windows, so that wrapped notices
are found. A block's tokens are its distinct words. A template is contained if at least ``threshold`` of its
distinct tokens are in a block. (Lines are not joined to longer blocks: long sentences hold a short
template's words by chance. So a wrapped notice with more words put in between than a window has room
for is not found.) The join finds all such pairs:

* Tokens are ordered by their frequency in the whole corpus, rarest first. Only the tokens of
  templates need a frequency, so counting takes a table of the templates' size.
* Prefix filter: a block that meets the threshold holds one of the template's first
  ``|T| - need + 1`` tokens, so only words in such prefixes are kept from the exploded blocks.
* Length filter: a block has at least ``need`` distinct words.
* Positional filter: a first match at place i of the template's order leaves at most ``|T| - i``
  common tokens.
* Candidates that are left are verified by the size of the intersection.
* Windows are found in pieces of twice the longest window, which begin one longest window apart, so
  that each window lies within a piece. Pieces pass the same filters as blocks; then the windows of
  those that are left are verified one by one.

The template table is code, of bounded size, and is broadcast. Documents never leave their
partition until a few candidates do; there is no shuffle of words.

Base places of a phrase are counted apart, over the words of the whole text.

Defined results: null and empty texts have 0 words, no places and no labels; score 0. Repeated rows
give a row each; rows that share a doc_id (or have none) get the labels of their own text, which goes
along as a hash. Lower-casing takes all of Unicode: phrases and templates are ASCII, so this only
folds the Kelvin sign to k beyond A-Z, a letter that no phrase has. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Notices as they stand in files; each sentence is a template of its own.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "All rights reserved"),
)
THRESHOLD = 0.9


def clean(text: Column) -> Column:
    """The words of a text, in lower case, one space apart."""
    return F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " "))


def _template_rows(spark: SparkSession, templates, threshold: float) -> DataFrame:
    """template, label, token, size, need; a row for each distinct token."""
    values = ", ".join(f"({i}, '{label}', '{text.replace(chr(39), ' ')}')" for i, (label, text) in enumerate(templates))
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, label, body)")
    tokens = F.array_distinct(F.split(clean(F.col("body")), " "))
    words = F.size(F.split(clean(F.col("body")), " "))
    return rows.select("template", "label", F.explode(tokens).alias("token"), F.size(tokens).alias("size"), words.alias("long")).withColumn("need", F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)).cast("int"))


#: As SEPARATORS, but for line breaks.
WITHIN = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def cleaned_blocks(text: Column) -> Column:
    """The words of a text in lower case, one space apart, and a line break between lines and sentences."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"[\n\r]+|[.!?]\s+", "\n")), WITHIN, " ")


def _window(words: int, threshold: float) -> int:
    return math.ceil(words / threshold - 1e-9)


def license_blocks(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every pair of a template and a line's or sentence's block that meets the threshold, and, of each piece, the best window that does: doc_id, template, label, containment, words, and the text's hash."""
    spark = docs.sparkSession
    rows = _template_rows(spark, templates, threshold)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text")).where("text is not null")
    # Counts of template words over the whole corpus: words that no template has end in the hash join.
    every = docs.select(F.explode(F.split(cleaned_blocks(F.col("text")), "[ \n]")).alias("token"))
    frequency = written(every.join(F.broadcast(rows.select("token").distinct()), "token").groupBy("token").count(), "license-frequency")
    order = Window.partitionBy("template").orderBy(F.coalesce("count", F.lit(0)), "token")
    ranked = rows.join(frequency, "token", "left").withColumn("place", F.row_number().over(order) - 1)
    ranked = ranked.select("template", "label", "token", "size", "need", "long", "place").collect()  # words of the templates above
    prefixes = sorted({r["token"] for r in ranked if r["place"] <= r["size"] - r["need"]})
    # Prefix filter, on whole texts and then on blocks, before anything is exploded further.
    holds = F.lit(rf"(?<![^ \n])(?:{'|'.join(map(re.escape, prefixes))})(?![^ \n])")
    first = docs.select("doc_id", "hash", cleaned_blocks(F.col("text")).alias("text")).where(F.rlike("text", holds))
    blocks = first.select("doc_id", "hash", F.explode(F.split("text", "\n")).alias("words")).where(F.rlike("words", holds))
    blocks = blocks.select("doc_id", "hash", F.split(F.trim("words"), " ").alias("words"), F.lit(False).alias("piece"))
    longest = max(_window(r["long"], threshold) for r in ranked)
    whole = first.select("doc_id", "hash", F.split(F.trim(F.regexp_replace("text", "[ \n]+", " ")), " ").alias("words"))
    starts = F.sequence(F.lit(1), F.size("words"), F.lit(longest))
    pieces = whole.select("doc_id", "hash", F.explode(F.transform(starts, lambda i: F.slice("words", i, 2 * longest))).alias("words"))
    pieces = pieces.where(F.arrays_overlap("words", F.array(*map(F.lit, prefixes)))).withColumn("piece", F.lit(True))
    first = blocks.unionByName(pieces).withColumn("own", F.array_distinct("words"))
    by = {}
    for r in sorted(ranked, key=lambda r: (r["template"], r["place"])):
        by.setdefault((r["template"], r["label"], r["size"], r["need"], _window(r["long"], threshold)), []).append(r["token"])
    listed = F.array(*[F.struct(F.lit(t).alias("template"), F.lit(lab).alias("label"), F.lit(size).alias("size"), F.lit(need).alias("need"), F.lit(window).alias("window"), F.array(*[F.lit(x) for x in tokens]).alias("tokens")) for (t, lab, size, need, window), tokens in by.items()])
    pairs = first.where(F.size("own") >= F.lit(min(k[3] for k in by))).select("doc_id", "hash", "words", "own", "piece", F.explode(listed).alias("t")).where(F.size("own") >= F.col("t.need"))
    head = F.slice(F.col("t.tokens"), 1, F.col("t.size") - F.col("t.need") + 1)
    place = F.array_position(F.col("t.tokens"), F.element_at(F.array_intersect(head, F.col("own")), 1))
    pairs = pairs.where(F.arrays_overlap(head, F.col("own"))).where(F.col("t.size") - place + 1 >= F.col("t.need"))
    pairs = pairs.withColumn("common", F.size(F.array_intersect(F.col("t.tokens"), F.col("own")))).where(F.col("common") >= F.col("t.need"))
    # Of a piece, its best window counts; other blocks count whole.
    window = F.col("t.window")
    places = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    common = lambda i: F.size(F.array_intersect(F.col("t.tokens"), F.slice("words", i, window)))
    best = F.array_max(F.transform(places, lambda i: F.struct(common(i).alias("common"), (-i).alias("back"))))
    pairs = pairs.withColumn("best", F.when(F.col("piece"), best).otherwise(F.struct(F.col("common").alias("common"), F.lit(-1).alias("back"))))
    pairs = pairs.where(F.col("best.common") >= F.col("t.need"))
    words = F.array_join(F.when(F.col("piece"), F.slice("words", -F.col("best.back"), window)).otherwise(F.col("words")), " ")
    return pairs.select("doc_id", "hash", F.col("t.template").alias("template"), F.col("t.label").alias("label"), (F.col("best.common") / F.col("t.size")).alias("containment"), words.alias("words"))


def base_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash (of the text), n_words, n_base, first_word, last_word, base (array of labels); a row a document."""
    text = clean(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("hash"), text.alias("words"))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    rows = rows.withColumn("n_words", F.when(F.col("words") == "", 0).otherwise(spaces(F.col("words")) + 1).cast("long"))
    # Two spaces between words: a phrase then ends and begins with a space of its own.
    wide = F.when(F.col("words").contains("license"), F.concat(F.lit(" "), F.replace("words", F.lit(" "), F.lit("  ")), F.lit(" "))).otherwise("")
    rows = rows.select("doc_id", "hash", "n_words", wide.alias("wide"))
    counts, firsts, lasts, labels = [], [], [], []
    for label, phrase in PHRASES.items():
        mark = f" {phrase.replace(' ', '  ')} "
        n = ((F.length("wide") - F.length(F.replace("wide", F.lit(mark), F.lit("")))) / F.lit(len(mark))).cast("long")
        word = lambda c: ((F.length(c) - F.length(F.replace(c, F.lit("  "), F.lit("")))) / 2).cast("long")
        before, after = F.substring_index("wide", mark, 1), F.substring_index("wide", mark, -1)
        # Words before: each but the first has two spaces before it; the last one's own closing space joins the mark's.
        first = F.when(before == "", F.lit(0)).otherwise(F.regexp_count(before, F.lit("[^ ]+")).cast("long"))
        last = F.col("n_words") - F.regexp_count(after, F.lit("[^ ]+")) - F.lit(phrase.count(" ") + 1)
        hit = F.col("wide").contains(mark)
        counts.append(F.when(hit, n).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(hit, first))
        lasts.append(F.when(hit, last))
        labels.append(F.when(hit, F.lit(label)))
    return rows.select(
        "doc_id",
        "hash",
        "n_words",
        reduce(lambda a, b: a + b, counts).alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
    )


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (largest containment found, 0 if none)."""
    found = license_blocks(docs, templates, threshold, id_col, text_col).groupBy("doc_id", "hash").agg(F.collect_set("label").alias("more"), F.max("containment").alias("score"))
    found = found.withColumnsRenamed({"doc_id": "found_id", "hash": "found_hash"})
    base = base_places(docs, id_col, text_col)
    joined = base.join(found, F.expr("doc_id <=> found_id and hash = found_hash"), "left")
    both = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    """Base places and labels of every whole text of ``documents``; a row a document, see above for nulls and repeats."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    sep = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows = ", ".join(f"({i}, '{lab}', '{body}')" for i, (lab, body) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{lab}', '{p}')" for lab, p in PHRASES.items())
    return rf"""
WITH raw(template, label, body) AS (VALUES {rows}),
tpl AS (SELECT template, label, list_distinct(string_split(trim(regexp_replace(lower(body), '{sep}', ' ', 'g')), ' ')) AS tokens FROM raw),
blk AS (
  SELECT doc_id, list_distinct(string_split(words, ' ')) AS own FROM (
    SELECT doc_id, trim(regexp_replace(lower(b), '{sep}', ' ', 'g')) AS words FROM (
      SELECT doc_id, unnest(regexp_split_to_array(text, '[\n\r]+|[.!?][ \t\n\x0B\f\r]+')) AS b FROM documents WHERE text IS NOT NULL)) WHERE words <> ''),
cand AS (SELECT * FROM blk WHERE list_has_any(own, (SELECT list(t) FROM (SELECT DISTINCT unnest(tokens) AS t FROM tpl)))),
hit AS (SELECT doc_id, label, len(list_intersect(tokens, own)) / len(tokens) AS c FROM cand, tpl WHERE len(list_intersect(tokens, own)) >= ceil(len(tokens) * {THRESHOLD} - 1e-9)),
more AS (SELECT doc_id, list(DISTINCT label) AS more, max(c) AS score FROM hit GROUP BY doc_id),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{sep}'), lambda x: x <> '') AS ws FROM documents),
p(label, phrase) AS (VALUES {phrases}),
pos AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w),
base AS (
  SELECT doc_id, label, i FROM pos, p
  WHERE ws[i + 1] = string_split(phrase, ' ')[1] AND array_to_string(ws[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase),
b AS (SELECT doc_id, count(*)::BIGINT AS n, min(i)::BIGINT AS f, max(i)::BIGINT AS l, list(DISTINCT label) AS base FROM base GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_base, f AS first_word, l AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN more USING (doc_id)
"""


OP5_SQL = _sql()
