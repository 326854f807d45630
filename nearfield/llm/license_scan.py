"""Licence notices by phrase, and by set-similarity join of text blocks with notice templates.

A block is any run of consecutive words, wherever its lines break, of as many words as a template has and those
that it may lack. It matches the template if it contains at least ``CONTAINMENT`` of the template's distinct
words. The join puts the words of all templates in one global order, rarest in the corpus first, and looks at each
occurrence of a word as the rarest that a block shares with a template of T words. With an overlap of o needed

* prefix filter: the word is among the first T - o + 1 of the template;
* length filter: as many words around it, not rarer than it, belong to the template as are needed;
* position filter: the template's words from this one on suffice for o;

and what passes is verified on each block around the occurrence. Every matching block has a rarest shared word, so
no pair is missed. Templates are a list of fixed texts, so their broadcast is bounded. Everything runs on the JVM.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import WORD, words_column

CONTAINMENT = 0.8

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Licence families, and passages of public licence notices. Of a passage of up to four words none may
# lack; longer ones differ from those of other families in more than a fifth of their words.
TEMPLATES = [
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "Lesser General Public License"),
    ("AGPL", "Affero General Public License"),
    ("Apache", "Apache License, Version 2"),
    ("Apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL", "Mozilla Public License"),
    ("EPL", "Eclipse Public License"),
    ("CC-BY", "Creative Commons Attribution"),
    ("CC-BY-NC", "CC BY-NC"),
    ("CC-BY-SA", "CC BY-SA"),
    ("CC-BY-ND", "CC BY-ND"),
    ("CC0", "dedicated to the public domain under CC0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(templates: list[tuple[str, str]], containment: float) -> list[tuple[str, list[str], int, int]]:
    """(label, distinct words, words that a block needs, words of a block) of each template."""
    found = []
    for label, text in templates:
        words = re.findall(WORD + "+", text.translate(str.maketrans(_UPPER, _LOWER)))
        distinct = list(dict.fromkeys(words))
        need = max(1, math.ceil(round(containment * len(distinct), 9)))
        found.append((label, distinct, need, len(words) + len(distinct) - need))
    return found


def word_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each of a fixed list of words occurs in the corpus."""
    counted = docs.select(F.explode(words_column(F.col("text"))).alias("w")).where(F.col("w").isin(words)).groupBy("w").count()
    return dict.fromkeys(words, 0) | {r["w"]: r["count"] for r in counted.collect()}  # at most one row for each word of the list


def _starts(w: Column) -> Column:
    """Place and label of each occurrence of a phrase in a list of words."""

    def at(x: Column, i: Column) -> Column:
        cases = []
        for phrase, label in PHRASES.items():
            first, *rest = phrase.split()
            found = x == first
            for n, word in enumerate(rest, 1):
                found = found & F.get(w, i + n).eqNullSafe(word)
            cases.append(F.when(found, label))
        return F.struct(i.cast("long").alias("i"), F.coalesce(*cases).alias("label"))

    return F.filter(F.transform(w, at), lambda s: s["label"].isNotNull())


def find_phrases(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_base, first_word, last_word and base_labels (array) of each row."""
    # Every phrase has one of these words.
    may = lambda w: F.array_contains(w, "license") | F.array_contains(w, "by")
    none = F.array().cast("array<struct<i:bigint,label:string>>")
    counted = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.when(may(w), _starts(w)).otherwise(none).alias("s"))
    # The list of words is the only element of a list, so that it is worked out once.
    hit = docs.select("doc_id", "text_hash", F.transform(F.array(words_column(F.col("text"))), counted)[0].alias("f"))
    hit = hit.select("doc_id", "text_hash", F.col("f.n").alias("n_words"), F.col("f.s").alias("s"))
    return hit.select(
        "doc_id", "text_hash", "n_words", F.size("s").cast("long").alias("n_base"),
        F.get("s", F.lit(0))["i"].alias("first_word"), F.get("s", F.size("s") - 1)["i"].alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("s", lambda x: x["label"]))).alias("base_labels"),
    )


def match_templates(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, text_hash, template (number), label, word (where it is matched) and containment of the blocks at the threshold.

    A row for each template and each occurrence of a word that is the rarest of a matching block; its containment
    is that of the best such block.
    """
    spark = docs.sparkSession
    sets = template_words(templates, containment)
    counts = word_counts(docs, sorted({w for _, words, *_ in sets for w in words}))
    order = sorted(counts, key=lambda w: (counts[w], w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes, first = [], set()
    for number, (label, words, need, reach) in enumerate(sets):
        ranks = sorted(rank[w] for w in words)
        prefixes += [(r, i, number, label, ranks, need, reach) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
        first.update(ranks[: len(ranks) - need + 1])
    prefix = spark.createDataFrame(prefixes, "rank int, place int, template int, label string, ranks array<int>, need int, reach int")
    widest = max((p[-1] for p in prefixes), default=1)

    known, rare = F.array(*[F.lit(w) for w in order]).cast("array<string>"), F.array(*[F.lit(order[r]) for r in sorted(first)]).cast("array<string>")
    number = lambda x, i: F.struct(i.alias("i"), (F.array_position(known, x).cast("int") - 1).alias("r"))
    hits = lambda w: F.filter(F.transform(w, number), lambda h: h["r"] >= 0)
    rarest = F.array(*[F.lit(r) for r in sorted(first)]).cast("array<int>")

    def around(h: Column) -> Column:
        """Each occurrence of a prefix word, with the template words that stand near it."""
        near = lambda x, j: F.struct(x["i"].alias("i"), x["r"].alias("r"), F.slice(h, F.greatest(j - widest + 2, F.lit(1)), 2 * widest).alias("near"))
        return F.filter(F.transform(h, near), lambda x: F.array_contains(rarest, x["r"]))

    none = F.array().cast("array<struct<i:int,r:int,near:array<struct<i:int,r:int>>>>")
    listed = F.transform(F.array(words_column(F.col("text"))), lambda w: F.when(F.arrays_overlap(w, rare), F.transform(F.array(hits(w)), around)[0]).otherwise(none))[0]
    placed = docs.select("doc_id", "text_hash", F.explode(listed).alias("a")).select("doc_id", "text_hash", F.col("a.i").alias("at"), F.col("a.r").alias("rank"), "a.near")

    pairs = placed.join(F.broadcast(prefix), "rank")
    mine = F.filter("near", lambda x: (F.abs(x["i"] - F.col("at")) < F.col("reach")) & (x["r"] >= F.col("rank")) & F.array_contains("ranks", x["r"]))
    different = lambda l: F.size(F.array_distinct(F.transform(l, lambda x: x["r"])))
    pairs = pairs.where(F.size("ranks") - F.col("place") >= F.col("need"))  # position
    pairs = pairs.withColumn("near", mine).where(different("near") >= F.col("need"))  # length
    # A block that matches can start at one of the template's words.
    shared = F.transform("near", lambda s: F.when(s["i"] <= F.col("at"), different(F.filter("near", lambda x: (x["i"] >= s["i"]) & (x["i"] < s["i"] + F.col("reach")) & (F.col("at") < s["i"] + F.col("reach"))))))
    pairs = pairs.withColumn("shared", F.array_max(shared)).where(F.col("shared") >= F.col("need"))
    return pairs.select("doc_id", "text_hash", "template", "label", F.col("at").alias("word"), (F.col("shared") / F.size("ranks")).alias("containment"))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Phrases and template matches of each row.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels and labels (sorted arrays), score (the
    greatest containment; 1 where a phrase stands; 0 without either). Null and empty texts have no words and
    no labels. Rows may repeat: each gets the result of its own text. Extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    base = find_phrases(docs)
    found = match_templates(docs, templates, containment)
    found = found.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "more", "best")
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>"))))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
