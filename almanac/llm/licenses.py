"""Operator 3: licence scan, with DataFrame functions only.

A text is compared in five kinds of units: as a whole, by paragraph (between blank lines), by line, by sentence within a line, and
by window of words anywhere in the text, so that a notice in a comment block or amid other words is found too. A unit is normalised
to lower-case words of letters and digits and compared with every template by the Dice coefficient of their sets of word bigrams. Two bounds prune exactly: a Dice coefficient of t needs sizes in the ratio t / (2 - t) at least, so
units outside all size ranges go before any bigram is compared; and it needs so many shared bigrams that one of any few of
a template's must be among them, so a few telling words are looked for first, and only units that hold a bigram with one of
them meet its templates. The templates are a fixed list; their tables have one row per template or telling bigram.

Windows have as many bigrams as a template's size range allows. The best one begins and ends with a bigram of the template, and
each holds a telling bigram, so only the bigrams around those are looked at. Of windows of one licence that overlap, the best stays
(ties: the shorter, then the earlier); its position is that of its first word.

Defined results: null, empty and one-word units match nothing; a template that is found in several units of a document is reported
for each; of several templates of one licence the best counts (ties: the first in the list); rows without id are kept; rows
repeated with equal id give one finding; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import BOOK, read

LEAST_DICE = 0.8

#: Licence and notice text as its publisher words it.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
     "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
     "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
     "limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
     "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
     "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
     "version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


#: Words too frequent to tell a licence.
COMMON = set("a an and any are as at be by for from in is it may not of on or out that the this to under with without you".split())


def template_words(text: str) -> list[str]:
    return re.sub(r"[^\w]+|_", " ", text.lower()).split()


def template_rows(templates: Sequence[tuple[str, str]], least: float) -> tuple[list[tuple], list[tuple[int, str]], list[str]]:
    """Templates as (template, licence, bigrams, size, lowest, highest), their telling bigrams as (template, bigram), and words of
    which every match holds one. A match shares so many bigrams with a template that it can miss fewer than ``n - needed + 1``; so
    one of any so many is in it. Words are chosen until the bigrams that hold one are so many for every template."""
    sets = [sorted({f"{a} {b}" for a, b in zip(w, w[1:])}) for w in (template_words(t) for _, t in templates)]
    ratio = least / (2 - least)
    lacking = {i: len(s) - _up(len(s) * ratio) + 1 for i, s in enumerate(sets)}
    chosen: list[str] = []
    while lacking:
        gain = Counter(w for i in lacking for b in sets[i] if not set(b.split()) & set(chosen) for w in set(b.split()))
        chosen.append(min(gain, key=lambda w: (w in COMMON or w.isdigit(), len(w) < 4, -gain[w], w)))
        held = {i: sum(bool(set(b.split()) & set(chosen)) for b in sets[i]) for i in lacking}
        lacking = {i: n for i, n in lacking.items() if held[i] < n}
    rows = [(i, name, s, len(s), _up(len(s) * ratio), int(len(s) / ratio + 1e-9)) for i, ((name, _), s) in enumerate(zip(templates, sets))]
    telling = [(i, b) for i, s in enumerate(sets) for b in s if set(b.split()) & set(chosen)]
    return rows, telling, chosen


def _up(x: float) -> int:
    return -int(-(x - 1e-9) // 1)


def normal(text: Column) -> Column:
    """Lower-case words of letters and digits with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    return F.array_distinct(F.zip_with(
        F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def tells(text: Column, telling: Sequence[str]) -> Column:
    # The one-element array has the text lowered once, whatever the number of words.
    return F.exists(F.array(F.lower(text)), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in telling]))


def units(docs: DataFrame, id_col: str, text_col: str, telling: Sequence[str]) -> DataFrame:
    """(doc, unit, position, words) of all units of at least two words that hold a telling word."""
    def named(unit: str, parts: Column) -> Column:
        return F.transform(parts, lambda t, i: F.struct(F.lit(unit).alias("unit"), i.alias("position"), t.alias("text")))

    text = F.col("text")
    lines = F.split(text, r"\n")
    # A sentence is a unit of its own where its line has several, a text or paragraph where it has several lines.
    sentences = F.flatten(F.transform(lines, lambda t, i: F.transform(
        F.split(t, r"(?<=[.!?])\s+"), lambda s: F.struct(F.lit("sentence").alias("unit"), i.alias("position"), s.alias("text"), t.alias("whole")))))
    sentences = F.transform(F.filter(sentences, lambda s: s["text"] != s["whole"]),
                            lambda s: F.struct(s["unit"].alias("unit"), s["position"].alias("position"), s["text"].alias("text")))
    larger = F.concat(named("text", F.array(text)), named("paragraph", F.split(text, r"\n[\x20\t\r]*\n")))
    larger = F.filter(larger, lambda u: F.instr(u["text"], "\n") > 0)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).filter(tells(text, telling))
    every = texts.select("doc", F.explode(F.concat(larger, named("line", lines), sentences)).alias("u")).select("doc", "u.*")
    words = F.split(normal(text), " ")
    return every.filter(tells(text, telling)).select("doc", "unit", "position", words.alias("words")).filter(F.size("words") > 1)


def apart(ordered: str) -> Column:
    """Of windows (worse, length in bigrams, position), best first, those that share no word with a better one that stays."""
    return F.aggregate(ordered, F.slice(ordered, F.lit(1), F.lit(0)), lambda chosen, w: F.when(
        F.exists(chosen, lambda c: (c["position"] <= w["position"] + w["length"]) & (w["position"] <= c["position"] + c["length"])), chosen
    ).otherwise(F.array_append(chosen, w)))


def windows(
    docs: DataFrame, id_col: str, text_col: str, table: DataFrame, firsts: Sequence[tuple[int, str]], telling: Sequence[str], reach: int,
    least: float,
) -> DataFrame:
    """(doc, unit, position, licence, dice) of the best windows of words; ``reach`` is the size of the largest window in bigrams."""
    text = F.col("text")
    known = sorted({b for _, b in firsts})
    ours: dict[int, list[str]] = {}
    for i, b in firsts:
        ours.setdefault(i, []).append(b)
    spark = docs.sparkSession
    first = spark.createDataFrame([(i, b, ours[i]) for i, b in firsts], "template int, bigram string, telling array<string>")

    def around(words: Column) -> Column:
        # Lambda variables are arrays made once; the bigrams around a telling one are cut out before anything is exploded.
        every = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1),
                           lambda a, b: F.concat(a, F.lit(" "), b))
        return F.flatten(F.transform(F.array(every), lambda pairs: F.transform(
            F.filter(F.transform(pairs, lambda b, i: F.struct(b.alias("bigram"), i.alias("at"))), lambda h: h["bigram"].isin(known)),
            lambda h: F.struct(h["bigram"].alias("bigram"), h["at"].alias("at"), F.greatest(h["at"] - reach + 1, F.lit(0)).alias("begin"),
                               F.slice(pairs, F.greatest(h["at"] - reach + 1, F.lit(0)) + 1,
                                       h["at"] - F.greatest(h["at"] - reach + 1, F.lit(0)) + reach).alias("near")))))

    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).filter(tells(text, telling))
    several = F.transform(F.array(F.split(normal(text), " ")), lambda w: F.when(F.size(w) > 1, around(w)))
    found = texts.select("doc", F.xxhash64("text").alias("key"), F.explode(F.flatten(several)).alias("h")).select("doc", "key", "h.*")
    met = found.join(F.broadcast(first), "bigram").join(F.broadcast(table), "template").filter(
        F.size(F.array_intersect("near", "model")) >= F.col("lowest"))
    # A window belongs to its first telling bigram: it starts behind the one before.
    here = F.col("at") - F.col("begin")
    seen = F.filter(F.transform(F.slice("near", F.lit(1), here), lambda b, i: F.when(F.array_contains("telling", b), i + 1)), lambda i: i.isNotNull())
    start = F.greatest(F.coalesce(F.array_max(seen), F.lit(0)), here - F.col("highest") + 1, F.lit(0))
    starts = F.transform(F.filter(F.sequence(start, here), lambda i: F.array_contains("model", F.element_at("near", i + 1))),
                         lambda i: F.struct((F.col("begin") + i).alias("position"), F.slice("near", i + 1, F.col("highest")).alias("next")))
    begun = met.select("doc", "key", "licence", "model", "size", "lowest", F.explode(starts).alias("s")).select(
        "doc", "key", "licence", "model", "size", "lowest", "s.*").filter(F.size(F.array_intersect("next", "model")) >= F.col("lowest"))
    steps = F.transform("next", lambda b, i: F.struct((F.array_position("next", b) == i + 1).alias("new"), F.array_contains("model", b).alias("hit")))

    def step(a: Column, t: Column) -> Column:
        shared, own = a["shared"] + (t["new"] & t["hit"]).cast("int"), a["own"] + t["new"].cast("int")
        dice = 2 * shared / (own + F.col("size"))
        better = dice > a["dice"]
        return F.struct(shared.alias("shared"), own.alias("own"), (a["n"] + 1).alias("n"), F.when(better, dice).otherwise(a["dice"]).alias("dice"),
                        F.when(better, a["n"] + 1).otherwise(a["length"]).alias("length"))

    none = F.struct(*[F.lit(0).alias(c) for c in ("shared", "own", "n")], F.lit(0.0).alias("dice"), F.lit(0).alias("length"))
    best = begun.select("doc", "key", "licence", "position", F.aggregate(steps, none, step).alias("b")).filter(F.col("b.dice") >= least)
    ordered = F.sort_array(F.collect_set(F.struct((-F.col("b.dice")).alias("worse"), F.col("b.length").alias("length"), "position")))
    groups = best.groupBy("doc", "key", "licence").agg(ordered.alias("ordered")).withColumn("w", F.explode(apart("ordered")))
    return groups.select("doc", F.lit("window").alias("unit"), F.col("w.position").alias("position"), "licence", (-F.col("w.worse")).alias("dice"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = tuple(TEMPLATES),
    least: float = LEAST_DICE,
) -> DataFrame:
    """(doc, unit, position, licence, dice): every unit with the licences it matches."""
    spark = docs.sparkSession
    rows, firsts, telling = template_rows(templates, least)
    table = spark.createDataFrame(rows, "template int, licence string, model array<string>, size int, lowest int, highest int")
    first = spark.createDataFrame(firsts, "template int, bigram string")
    found = units(docs, id_col, text_col, telling).withColumn("pairs", bigrams(F.col("words"))).drop("words")
    found = found.filter(F.size("pairs").between(min(r[4] for r in rows), max(r[5] for r in rows)))
    known = F.array(*[F.lit(b) for b in sorted({b for _, b in firsts})])
    near = found.filter(F.arrays_overlap("pairs", known))
    hits = near.withColumn("bigram", F.explode(F.array_intersect("pairs", known)))
    met = hits.join(F.broadcast(first), "bigram").join(F.broadcast(table), "template").filter(F.size("pairs").between(F.col("lowest"), F.col("highest")))
    dice = 2 * F.size(F.array_intersect("pairs", "model")) / (F.size("pairs") + F.col("size"))
    scored = met.select("doc", "unit", "position", "licence", dice.alias("dice")).filter(F.col("dice") >= least)
    around = windows(docs, id_col, text_col, table, firsts, telling, max(r[5] for r in rows), least)
    return scored.unionByName(around).groupBy("doc", "unit", "position", "licence").agg(F.max("dice").alias("dice"))


@BOOK.add("op3_license_scan")
def op3_license_scan(spark, sf_dir):
    return scan(read(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")
