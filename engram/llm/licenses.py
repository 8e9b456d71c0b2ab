"""License texts: phrases, and an exact containment join of text windows with templates.

All of it is column expressions. A template is a set of words; a window of a text contains
it if it has at least ``threshold`` of them. Words are ordered by the number of texts that have
them, the rarest first. Of a template with n words of which a must occur, a window can only miss
n - a, so it has one of the first n - a + 1: only windows around such words are looked at (prefix
filter). They must have at least a words of any template (length filter), and behind the first shared word
of both orders enough words must be left (positional filter). What remains is intersected.

Windows of a template of n words are 2n words long and start every n words, so every run of n words
lies whole within one, wherever it stands in a line or page.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.scratch import Scratch

THRESHOLD = 0.8
TILE = 256
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Sentences of public licenses and notices, with their labels
TEMPLATES = [
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit-permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-disclaimer", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


class Template:
    """Words of a template, the rarest first; ``need`` of them must occur."""

    def __init__(self, label: str, words: list[str], threshold: float):
        self.label, self.words = label, words
        self.need = max(1, math.ceil(threshold * len(words) - 1e-9))
        self.prefix = len(words) - self.need + 1


def _normal(text: Column) -> Column:
    """Lower-cased words with one blank between, before and after them; one blank if there is none."""
    # lower() also maps letters beyond A-Z, but these are letters of words before and after
    bare = F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " "))
    return F.replace(F.concat(F.lit(" "), bare, F.lit(" ")), F.lit("  "), F.lit(" "))


def _n_words(normal: Column) -> Column:
    return (F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit(""))) - 1).cast("bigint")


def _places(normal: Column, phrases: list[tuple[str, str]]) -> Column:
    """(n, first, last, labels): how often the phrases stand in a normalised text, and where."""
    # doubled blanks, so that places next to each other do not share one
    double = F.replace(normal, F.lit(" "), F.lit("  "))
    size = F.length(double)
    n, first, last, labels = F.lit(0), [F.lit(None).cast("bigint")], [F.lit(None).cast("bigint")], []
    for phrase, label in phrases:
        words = phrase.split(" ")
        wanted = " " + "  ".join(words) + " "
        cut = F.replace(double, F.lit(wanted), F.lit(""))
        times = ((size - F.length(cut)) / len(wanted)).cast("int")
        before = F.substring_index(double, wanted, 1)
        after = F.substring_index(double, wanted, -1)
        has = double.contains(wanted)
        # a pair of blanks on either side of every word, but for one that the phrase has taken
        count = lambda part: ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit(""))) - 1) / 2).cast("bigint")
        n = n + F.when(has, times).otherwise(0)
        first.append(F.when(has, count(before)))
        last.append(F.when(has, _n_words(normal) - count(after) - len(words)))
        labels.append(F.when(has, F.lit(label)))
    return F.struct(
        n.cast("bigint").alias("n"), F.least(*first).alias("first"), F.greatest(*last).alias("last"),
        F.array_compact(F.array(*labels)).alias("labels"),
    )


def _profile(rows: DataFrame, phrases: list[tuple[str, str]], templates: list[Template]) -> DataFrame:
    """Phrase places of every text; the words of texts that have enough of them for some template."""
    vocabulary = sorted({w for t in templates for w in t.words})
    normal = rows.select("doc_id", _normal(F.coalesce(F.col("text"), F.lit(""))).alias("normal"))
    words = normal.withColumn("n_words", _n_words(F.col("normal"))).withColumn("words", F.split("normal", " "))
    known = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    words = words.withColumn("known", known)
    enough = F.lit(False)
    for t in templates:
        enough = enough | (F.size(F.array_intersect("known", F.array(*map(F.lit, t.words)))) >= t.need)
    may = F.lit(False)
    for phrase, _ in phrases:
        may = may | F.col("normal").contains(f" {phrase} ")
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"),
                    F.expr("cast(array() as array<string>)").alias("labels"))
    # the split has an empty word at each end
    inner = F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0)))
    return words.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", F.when(may, _places(F.col("normal"), phrases)).otherwise(none).alias("base"),
        "known", F.when(enough, inner).alias("words"),
    )


def _contained(profile: DataFrame, templates: list[Template], threshold: float) -> DataFrame:
    """(row, labels, score) of the texts with a window that contains a template."""
    counted = profile.select(F.explode("known").alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in counted.collect()}  # at most one row per word of the templates
    order = sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for k, t in enumerate(templates):
        t.words.sort(key=rank.__getitem__)
        index += [(t.words[i], k, i) for i in range(t.prefix)]
    ranks = F.array(*map(F.lit, order))
    heads = sorted({w for w, _, _ in index})
    # tiles with room on both sides for every window that one of their own words lies in
    room = 2 * max(len(t.words) for t in templates)
    begin = lambda i: F.greatest(i * TILE - room, F.lit(0))
    tiles = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("words") - 1) / TILE).cast("int")),
        lambda i: F.struct(i.alias("no"), begin(i).alias("begin"), F.slice("words", begin(i) + 1, F.lit(TILE + 2 * room)).alias("words")),
    )
    texts = profile.filter("words is not null").select("row", F.explode(tiles).alias("tile")).select("row", "tile.*")
    at = texts.select("row", "no", "begin", "words", F.posexplode("words").alias("local", "word")).withColumn("pos", F.col("begin") + F.col("local"))
    at = at.filter(F.col("word").isin(heads) & (F.floor(F.col("pos") / TILE) == F.col("no")))

    def of(values, column: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), column + 1)

    entries = {w: [(k, i) for v, k, i in index if v == w] for w in heads}
    none = F.expr("cast(array() as array<struct<t:int,i:int>>)")
    hit = none
    for w, found in entries.items():
        hit = F.when(F.col("word") == w, F.array(*(F.struct(F.lit(k).alias("t"), F.lit(i).alias("i")) for k, i in found))).otherwise(hit)
    hits = at.select("row", "begin", "words", "pos", F.explode(hit).alias("hit")).select(
        "row", "begin", "words", "pos", F.col("hit.t").alias("t"), of([len(t.words) for t in templates], F.col("hit.t")).alias("n")
    )
    # a word lies in the window that starts at or before it, and in the one before that
    starts = F.explode(F.array_distinct(F.array(F.floor(F.col("pos") / F.col("n")), F.greatest(F.floor(F.col("pos") / F.col("n")) - 1, F.lit(0)))))
    windows = hits.select("row", "begin", "words", "t", "n", starts.alias("w")).select(
        "row", "t", "w", F.slice("words", (F.col("w") * F.col("n") - F.col("begin") + 1).cast("int"), 2 * F.col("n")).alias("window")
    )
    windows = windows.groupBy("row", "t", "w").agg(F.first("window").alias("window"))
    wanted = F.lit(None).cast("array<string>")
    need = of([t.need for t in templates], F.col("t"))
    size = of([len(t.words) for t in templates], F.col("t"))
    for k, t in enumerate(templates):
        wanted = F.when(F.col("t") == k, F.array(*map(F.lit, t.words))).otherwise(wanted)
    # both in the same order, the rarest first
    window = F.array_intersect(ranks, F.col("window"))
    sets = windows.select("row", "t", need.alias("need"), size.alias("n"), wanted.alias("wanted"), window.alias("window")).filter("size(window) >= need")
    lead = F.array_intersect("wanted", "window")[0]
    left = F.least(F.col("n") - F.array_position("wanted", lead), F.size("window") - F.array_position("window", lead)) + 1
    sure = sets.filter(left >= F.col("need")).select(
        "row", "t", "need", "n", F.size(F.array_intersect("wanted", "window")).alias("shared")
    ).filter("shared >= need")
    label = of([t.label for t in templates], F.col("t"))
    return sure.groupBy("row").agg(F.collect_set(label).alias("labels"), F.max(F.col("shared") / F.col("n")).alias("score"))


def find_licenses(
    documents: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, template_labels, score) per row.

    n_base counts all places where the words of a phrase follow one another, first_word and last_word are the least and the
    greatest of their starts (null without one), base_labels their labels. template_labels has the templates that a
    window of the text contains by at least ``threshold``; both lists are distinct and sorted. score is the
    highest containment among these, 1 where a phrase stands, else 0.

    ``templates`` are (label, words) and ``phrases`` (words, label), in lower case. Words are runs of a-z, 0-9 and all characters
    beyond ASCII. Null, empty and wordless texts have no words and no labels. Texts of any length are read whole.
    Words of equal count go by their letters. Repeated rows and null ids keep their rows; other columns are
    ignored; an empty table gives an empty one.
    """
    scratch = Scratch(documents.sparkSession, "licenses")
    chosen = PHRASES if phrases is None else phrases
    known = [Template(label, sorted(set(words.split(" "))), threshold) for label, words in (TEMPLATES if templates is None else templates)]
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    profile = scratch.keep(_profile(rows, chosen, known), "profile")
    found = _contained(profile, known, threshold)
    none = F.expr("cast(array() as array<string>)")
    return profile.select("row", "doc_id", "n_words", "base").join(found, "row", "left").select(
        "doc_id", "n_words", F.col("base.n").alias("n_base"), F.col("base.first").alias("first_word"), F.col("base.last").alias("last_word"),
        F.array_sort(F.array_distinct("base.labels")).alias("base_labels"), F.array_sort(F.coalesce("labels", none)).alias("template_labels"),
        F.when(F.col("base.n") > 0, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )
