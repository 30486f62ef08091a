"""License scans: normalised text against license templates by the Dice coefficient over word bigrams.

A document's units are its whole text, its paragraphs (between blank lines) and its lines; equal units of a document
count once. A unit is normalised - A-Z lower-cased, everything but [a-z0-9] a separator - and its bigrams are a bag, so
a unit of n words has n - 1 of them and Dice = 2 * shared / (a + b). Size bounds prune first: Dice >= t needs
a >= b * t / (2 - t) and a <= b * (2 - t) / t, so a unit whose size fits no template ends in its row, before any bigram
is made, and a bigram meets only the templates that its unit's size allows. A unit with Dice >= t shares at least
b * t / (2 - t) bigrams of the template; so of any set of words that lie in all but fewer of its bigrams it has one. Several
disjoint such sets are chosen for each template, and a text or unit that lacks all words of one can't match it and ends there too. Templates are a small literal table, at most
``MAX_TEMPLATE_BIGRAMS`` bigrams, checked, and broadcast; counts are summed before the one shuffle by unit.

DataFrame operations only. Defined results: null and empty texts, and texts whose units have fewer than two words, match
nothing (null license, score 0); ties go to the alphabetically first license; a row is its id and text, so repeated
rows give repeated results, and rows of one id with different texts are scored apart; other columns are not read, an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TEMPLATE_BIGRAMS = 200_000

#: Short license notices and license texts, by SPDX identifier; longer ones are in license_texts.txt.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}


def read_templates(path: str) -> dict[str, list[str]]:
    """Texts by license of a template file: "== ID" begins a license, "--" another of its texts, lines with # at the start of the file are remarks."""
    out: dict[str, list[str]] = {}
    with open(path, encoding="utf-8") as f:
        blocks = re.split(r"(?m)^== *", f.read())[1:]
    for block in blocks:
        name, _, texts = block.partition("\n")
        out.setdefault(name.strip(), []).extend(t.strip() for t in re.split(r"(?m)^--$", texts) if t.strip())
    return out


for _name, _texts in read_templates(os.path.join(os.path.dirname(__file__), "license_texts.txt")).items():
    TEMPLATES.setdefault(_name, []).extend(_texts)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def template_rows(templates: dict[str, list[str]], threshold: float) -> list[tuple[str, int, str, int, int, float, float]]:
    """(license, template, bigram, its count, bigrams of the template, least and largest size of a unit) of every bigram."""
    out = []
    number = 0
    for name in sorted(templates):
        for text in templates[name]:
            words = normalise(text).split()
            pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
            for p in sorted(set(pairs)):
                out.append((name, number, p, pairs.count(p), len(pairs), len(pairs) * threshold / (2 - threshold) - 1e-9, len(pairs) * (2 - threshold) / threshold + 1e-9))  # a size at a bound is inside
            number += 1
    if not out:
        raise ValueError("the templates have no bigrams")
    if len(out) > MAX_TEMPLATE_BIGRAMS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_BIGRAMS} bigrams can't be broadcast")
    return out


def telling_words(bigrams: dict[str, int], threshold: float) -> list[list[str]]:
    """Disjoint sets of words of a template (bigram -> count); every unit with at least the threshold has a word of each set.

    Such a unit shares at least b * t / (2 - t) of the b bigrams; a set's words are taken greedily, long ones first among
    equals, until fewer than that many bigrams have none of them.
    """
    need, out, used = sum(bigrams.values()) * threshold / (2 - threshold), [], set()
    while True:
        left, words = dict(bigrams), []
        while sum(left.values()) >= need - 1e-9:
            gain: dict[str, float] = {}
            for gram, n in left.items():
                for w in set(gram.split()) - used:
                    gain[w] = gain.get(w, 0) + n * min(len(w), 8) ** 2
            if not gain:
                return out
            words.append(max(sorted(gain), key=gain.get))
            left = {g: n for g, n in left.items() if words[-1] not in g.split()}
        out.append(words)
        used |= set(words)


def first_words(templates: list[dict[str, int]], threshold: float) -> list[str]:
    """A few words of which every unit that reaches the threshold with any of the templates holds one, if only inside another."""
    left = [dict(t) for t in templates]
    need = [sum(t.values()) * threshold / (2 - threshold) for t in templates]
    out: list[str] = []
    while open_ := [k for k, t in enumerate(left) if sum(t.values()) >= need[k] - 1e-9]:
        gain: dict[str, float] = {}
        for w in sorted({w for k in open_ for g in left[k] for w in g.split()}):
            gain[w] = sum(min(1.0, sum(n for g, n in left[k].items() if w in g) / (sum(left[k].values()) - need[k] + 1e-6)) for k in open_) * min(len(w), 8) ** 2
        out.append(max(gain, key=gain.get))
        left = [{g: n for g, n in t.items() if out[-1] not in g} for t in left]
    return out


def _fits(rows, threshold: float) -> tuple[str, str, str]:
    """SQL conditions: on a text t, that it has some template's telling words; on a unit's size n, and on x and n, that they fit some template."""
    by: dict[int, dict[str, int]] = {}
    bounds = {}
    for _, number, gram, times, _, lo, hi in rows:
        by.setdefault(number, {})[gram] = times
        bounds[number] = (lo, hi)
    has = lambda sets: " and ".join("(" + " or ".join(f"contains(x, '{w}')" for w in ws) + ")" for ws in sets)
    sets = {k: has(telling_words(g, threshold)) for k, g in by.items()}
    size = f"n >= {min(lo for lo, _ in bounds.values())!r}D and n <= {max(hi for _, hi in bounds.values())!r}D"
    first = " or ".join(f"contains(x, '{w}')" for w in first_words(list(by.values()), threshold))
    return f"exists(array(lower(t)), x -> ({first}) and ({' or '.join(f'({c})' for c in dict.fromkeys(sets.values()))}))", size, " or ".join(f"(n >= {lo!r}D and n <= {hi!r}D and {sets[k]})" for k, (lo, hi) in bounds.items())


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """(id_col, license, score, n_units) of every row: the best license, its Dice, and how many units match some license."""
    if not 0 < threshold <= 1:
        raise ValueError("0 < threshold <= 1 is needed")
    spark: SparkSession = docs.sparkSession
    rows = template_rows(TEMPLATES if templates is None else templates, threshold)
    grams = spark.createDataFrame(rows, "license string, template int, gram string, times int, b int, lo double, hi double")
    telling, size, fits = _fits(rows, threshold)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"))
    row = F.md5(F.concat(F.coalesce(F.concat(F.lit("i"), F.col("id").cast("string")), F.lit("n")), F.lit(":"), F.coalesce("t", F.lit(""))))
    flat = src.where(telling).select(row.alias("row"), F.lower(F.regexp_replace("t", "[^A-Za-z0-9\\n]+", " ")).alias("t"))
    joined = "x -> trim(regexp_replace(x, ' *\\n[ \\n]*', ' '))"
    parts = f"concat(transform(filter(array(t), x -> contains(x, '\\n')), {joined}), transform(filter(split(t, '\\n *\\n'), x -> contains(x, '\\n')), {joined}), transform(split(t, '\\n'), x -> trim(x)))"
    # An outer explode: of an inner one the optimiser infers a filter on the array, and pushes a copy of all this work below.
    units = flat.select("row", F.explode_outer(F.expr(parts)).alias("u"))
    units = units.where(F.expr(f"exists(array(octet_length(u) - octet_length(replace(u, ' ', ''))), n -> {size} and exists(array(u), x -> {fits}))")).distinct()  # equal units of a row, and equal rows, are scored once
    words = units.select("row", F.xxhash64("u").alias("unit"), F.split("u", " ").alias("w"))
    pairs = words.select("row", "unit", (F.size("w") - 1).alias("a"), F.explode_outer(F.expr("transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))")).alias("gram"))
    met = pairs.join(F.broadcast(grams), "gram").where("a >= lo and a <= hi")
    times = met.groupBy("row", "unit", "a", "license", "template", "b", "gram", "times").agg(F.count(F.lit(1)).alias("n"))
    dice = times.groupBy("row", "unit", "a", "license", "template", "b").agg(F.sum(F.least("n", F.col("times").cast("bigint"))).alias("m")).select("row", "unit", "license", (2 * F.col("m") / (F.col("a") + F.col("b"))).alias("score")).where(F.col("score") >= threshold)
    best = dice.groupBy("row").agg(F.max(F.struct("score")).alias("top"), F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("first"), F.countDistinct("unit").alias("n_units"))
    best = best.select("row", F.col("first.license").alias("license"), F.col("top.score").alias("score"), "n_units")
    out = src.select(row.alias("row"), "id").join(best, "row", "left")
    return out.select(F.col("id").alias(id_col), "license", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_units", F.lit(0)).cast("bigint").alias("n_units"))
