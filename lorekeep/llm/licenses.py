"""License scans by diagonal voting, in built-in expressions only.

All rolling word k-gram hashes of a text are joined to their positions in license notices.  A text that holds a
notice gives hits with one offset (text position minus notice position), so hits are counted by offset; neighbouring
offsets, which insertions and deletions cause, are merged; and each merged span is verified word by word.  A merged span
is at most twice as wide as ``merge_within`` (or a tenth of the notice), whatever the text: offsets are merged by cells of
two grids, one shifted by half a cell, so any two offsets that close share a cell.

Verification aligns the notice with the text inside the span: both in order, a word of either serving once, as many words as
possible, of equal alignments the shortest.  So words of a neighbouring notice don't count for this one.  Where the
words of two labels' spans are the same for half of the shorter one, the better covered one gives the label; if both are
covered alike, neither does.

The notices are a parameter of bounded size, so their side of the join is broadcast and no text moves: only hits and
one narrow row per document are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.plans.store import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose words in a row give a label by themselves.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: (label, wording) of well-known public notices.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
)
GRAM, MERGE_WITHIN, MIN_COVERAGE = 4, 4, 0.8
#: Words of a cell in which verified spans meet.
CELL_WORDS = 128
#: Words that all notices hold at most.
MAX_NOTICE_WORDS = 200_000
BROADCAST_BYTES = 64 << 20


def scan_words(text: Column) -> Column:
    """Words after lower-casing A-Z: runs of letters, digits and non-ASCII characters; empty for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def gram_hashes(words: Column, k: int) -> Column:
    """Array of (i, h) of all runs of ``k`` words."""
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), F.xxhash64(*[words[i + j] for j in range(k)]).alias("h"))))


def _places(words: Column, joined: Column, phrase: str) -> Column:
    """Starts of a phrase; only texts that hold it are searched word by word."""
    parts = phrase.split(" ")
    hit = lambda i: F.array_join(F.slice(words, i + 1, len(parts)), " ") == phrase
    return F.when(
        F.contains(joined, F.lit(f" {phrase} ")),
        F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), lambda i: (words[i] == parts[0]) & hit(i))).otherwise(F.array().cast("array<int>"))


def aligned(matched) -> Column:
    """struct(n, start, before) of the best alignment of the notice ``tw`` with a text between the offsets ``low`` and ``high``.

    matched: a function of a notice place and an offset to whether the words there count as equal.  n: aligned words, start: place of the
    first one in the text, before: minus that of the last.  The state has one entry an offset; a step takes one word of the notice,
    aligned or not, and then leaves out words of the text, which a running maximum over offsets stands for.
    """
    cell = "struct<n:int,start:int,before:int>"
    none = F.array().cast(f"array<{cell}>")
    band = F.sequence("low", "high")

    def step(state: Column, p: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            d = F.col("low") + k
            more = F.struct((x["n"] + 1).alias("n"), F.when(x["n"] == 0, p + d).otherwise(x["start"]).alias("start"), (-(p + d)).alias("before"))
            return F.greatest(F.when(matched(p, d), more).otherwise(x), F.coalesce(F.get(state, k + 1), x))

        best = lambda done, x: F.concat(done, F.array(F.greatest(x, F.coalesce(F.try_element_at(done, F.lit(-1)), x))))
        return F.aggregate(F.transform(state, one), none, lambda done, x: best(done, x).cast(f"array<{cell}>"))

    start = F.transform(band, lambda d: F.struct(F.lit(0).alias("n"), F.lit(0).alias("start"), F.lit(0).alias("before")))
    return F.element_at(F.aggregate(F.sequence(F.lit(0), F.size("tw") - 1), start.cast(f"array<{cell}>"), lambda state, p: step(state, p).cast(f"array<{cell}>")), -1)


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", notices=NOTICES, phrases=None, gram: int = GRAM, merge_within: int = MERGE_WITHIN,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of all phrases, first_word and last_word are the least and greatest of their starts (null
    without any).  labels adds to the phrases' labels those of notices of which ``min_coverage`` of the words align with the text
    inside one merged span, each beside a neighbour of the notice, and that no related notice covers as well.  score: 1 with a
    phrase, else the best coverage found, 0 without a label.  spans: (label, start, end, coverage) of the verified spans.
    Null and empty texts have no words and no labels; repeated rows get equal results; an empty table gives an empty one; a
    null id stays null; other columns are ignored.  Very long texts: their words are held once, hits are grouped by offset.
    """
    phrases = PHRASES if phrases is None else phrases
    spark = docs.sparkSession
    key = F.struct(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("th")).alias("key")
    worded = docs.select(key, scan_words(F.col(text)).alias("w"))

    known = spark.createDataFrame([(k, label, wording) for k, (label, wording) in enumerate(notices)], "t int, label string, wording string")
    known = known.select("t", "label", scan_words(F.col("wording")).alias("tw"))
    if sum(len(wording.split()) for _, wording in notices) > MAX_NOTICE_WORDS:
        raise ValueError(f"notices of over {MAX_NOTICE_WORDS} words: scan them in several calls")
    grams = known.select("t", F.size("tw").alias("size"), F.inline(gram_hashes(F.col("tw"), gram))).select("t", "size", F.col("i").alias("p"), "h")
    hits = worded.select("key", F.inline(gram_hashes(F.col("w"), gram))).join(F.broadcast(grams), "h")
    votes = hits.groupBy("key", "t", "size", (F.col("i") - F.col("p")).alias("diagonal")).agg(F.countDistinct("i").alias("votes"))
    near = F.greatest(F.lit(merge_within), F.floor(F.col("size") / 10)).cast("int")
    celled = votes.withColumn("near", near).withColumn("grid", F.explode(F.array(F.lit(0), F.lit(1))))
    celled = celled.withColumn("cell", F.floor((F.col("diagonal") + F.col("grid") * F.col("near")) / (2 * F.col("near"))))
    islands = celled.groupBy("key", "t", "grid", "cell").agg(
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"), F.first("size").alias("size"))
    islands = islands.where(F.col("votes") >= F.greatest(F.lit(1), F.floor(F.col("size") / 10))).select("key", "t", "low", "high").distinct()
    islands = materialize(islands, "spans")

    wanted = islands.select("key").distinct()
    if islands.count() * 128 <= BROADCAST_BYTES:  # beyond that the texts are shuffled
        wanted = F.broadcast(wanted)
    texts = docs.select(key, F.col(text).alias("text")).join(wanted, "key", "left_semi").dropDuplicates(["key"]).select("key", scan_words(F.col("text")).alias("w"))
    same = lambda p, d: (p >= 0) & (p + d >= 0) & (F.get("w", p + d) == F.get("tw", p))
    along = lambda p: lambda d: same(p, d) & (same(p - 1, d) | same(p + 1, d))  # noqa: E731  a word alone may meet by chance
    fits = lambda p: F.exists(F.sequence("low", "high"), along(p))
    met = islands.join(texts, "key").join(F.broadcast(known), "t").withColumn("met", F.filter(F.sequence(F.lit(0), F.size("tw") - 1), fits))
    met = met.where(F.size("met") / F.size("tw") >= min_coverage)  # an upper bound of what an alignment holds
    met = met.select("key", "label", F.size("tw").alias("size"), aligned(lambda p, d: along(p)(d)).alias("a"))
    met = met.select("key", "label", (F.col("a.n") / F.col("size")).alias("coverage"), F.col("a.start").alias("start"), (1 - F.col("a.before")).alias("end"))
    met = materialize(met.where(F.col("coverage") >= min_coverage).distinct(), "met")
    near = met.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / CELL_WORDS), F.floor((F.col("end") - 1) / CELL_WORDS))))
    rival = near.select("key", "cell", *[F.col(c).alias(f"r_{c}") for c in ("label", "coverage", "start", "end")])
    shared = F.least("end", "r_end") - F.greatest("start", "r_start")
    beaten = near.join(rival, ["key", "cell"]).where((F.col("label") != F.col("r_label")) & (F.col("coverage") <= F.col("r_coverage")) & (2 * shared >= F.least(F.col("end") - F.col("start"), F.col("r_end") - F.col("r_start"))))
    met = met.join(beaten.select("key", "label", "start", "end").distinct(), ["key", "label", "start", "end"], "left_anti")
    found = met.groupBy("key").agg(
        F.collect_set("label").alias("more"), F.max("coverage").alias("best"), F.sort_array(F.collect_set(F.struct("label", "start", "end", "coverage"))).alias("spans"))

    base = worded.withColumn("j", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    base = base.select("key", F.size("w").cast("long").alias("n_words"), *[_places(F.col("w"), F.col("j"), p).alias(f"p{k}") for k, p in enumerate(phrases)])
    names = [f"p{k}" for k in range(len(phrases))]
    starts = F.concat(*names) if names else F.array().cast("array<int>")
    marks = F.array_compact(F.array(*[F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(names, phrases.values(), strict=True)])) if names else F.array().cast("array<string>")
    base = base.select("key", "n_words", starts.alias("starts"), marks.alias("marks"))
    out = base.join(found, "key", "left")
    labels = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    return out.select(
        F.col("key.doc").alias(id_col), "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"), labels(F.col("marks")).alias("base_labels"),
        labels(F.concat("marks", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("marks") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "spans")
