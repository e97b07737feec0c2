"""Licence scans: parts of texts compared to licence templates, by Spark expressions only.

A part is a line, or a paragraph of two or more lines, or a text of two or more paragraphs. Parts and templates are normalised to words; their
likeness is the Dice coefficient of their sets of word bigrams. A part of a given number of bigrams can only reach
the threshold with templates of a size within a factor of it, and only if two thirds of its bigrams occur in templates at all, so only those are compared.
Besides, wherever the first bigram of a template stands in a text, the window of the template's length from there is compared to it: so a notice
is found inside a longer line, too.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.native import let

LEAST = 0.8

# Notices as their licences word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions:",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("BSD", "Licensed under the BSD 2-Clause License."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "CC0-1.0",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the "
        "public domain worldwide.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
)


def words_of_template(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams_of(text: str) -> list[str]:
    """The distinct word bigrams of a template."""
    words = words_of_template(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _words(part: Column) -> Column:
    return F.filter(F.split(part, "[ \n]+"), lambda word: word != "")


def _bigrams(words: Column) -> Column:
    """The word bigrams of some words, in order."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda word, i: F.concat(word, F.lit(" "), F.get(words, i + 1)))


def _normal(text: Column) -> Column:
    """Lower-cased words between single blanks and line ends."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")


def _parts(normal: Column) -> Column:
    """Lines, longer paragraphs and longer texts."""
    paragraphs = F.split(normal, r"\n *\n[ \n]*")
    longer = F.filter(paragraphs, lambda p: p.contains("\n"))
    whole = F.when(F.size(paragraphs) > 1, F.array(normal)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.split(normal, "\n"), longer, whole)


def scan(docs: DataFrame, key: str, text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``(key, license, n_parts, n_windows, dice)``: the licences found in each whole text, the parts and windows that match, and their best likeness.

    A part, or the windows from one place, match the licences whose templates they are most like, if that likeness is ``least`` or more. Texts without a match, null
    and empty ones give no row. Repeated keys are one. ``templates``: any number of
    ``(license, text)``; those with less than two words match nothing. Other columns are not read; texts are never shuffled.
    """
    known = [(name, grams, words_of_template(body)) for name, body in templates if (grams := bigrams_of(body))]
    if not known:
        none = F.lit(0).cast("bigint")
        return docs.select(key, F.lit("").alias("license"), none.alias("n_parts"), none.alias("n_windows"), F.lit(0.0).alias("dice")).limit(0)
    opening = [f"{words[0]} {words[1]}" for _, _, words in known]
    fields = [
        F.struct(F.lit(name).alias("license"), F.lit(len(grams)).alias("n"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(first).alias("first"), F.lit(len(words)).alias("words"))
        for (name, grams, words), first in zip(known, opening, strict=True)
    ]
    table = F.array(*fields)
    everything = sorted({gram for _, grams, _ in known for gram in grams})
    # Even if all of the smaller side is in the larger, Dice must reach the threshold.
    smallest = min(next(n for n in range(1, len(g) + 1) if 2.0 * n / (n + len(g)) >= least) for _, g, _ in known)
    # With x bigrams in common, 2 x / (n + m) and m >= x bound x from below by a share of n.
    share = least / (2 - least)

    def best(found: Column, part: int) -> Column:
        """Of each licence that is most alike one match."""
        top = F.array_max(F.transform(found, lambda m: m["dice"]))
        names = F.array_distinct(F.transform(F.filter(found, lambda m: (m["dice"] >= least) & (m["dice"] == top)), lambda m: m["license"]))
        return F.transform(names, lambda name: F.struct(name.alias("license"), top.alias("dice"), F.lit(part).alias("part")))

    def alike(grams: Column, rows: Column) -> Column:
        dice = lambda t: 2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["n"])
        return F.transform(rows, lambda t: F.struct(t["license"].alias("license"), dice(t).alias("dice")))

    none = F.array().cast("array<struct<license:string,dice:double,part:int>>")

    def of_part(part: Column) -> Column:
        def compared(grams: Column) -> Column:
            near = F.filter(table, lambda t: 2.0 * F.least(F.size(grams), t["n"]) / (F.size(grams) + t["n"]) >= least)
            enough = F.size(F.filter(grams, lambda g: g.isin(everything))) >= share * F.size(grams)
            return F.when((F.size(grams) >= smallest) & enough, let(alike(grams, near), lambda found: best(found, 1))).otherwise(none)

        return let(let(_words(part), lambda words: F.array_distinct(_bigrams(words))), compared)

    def of_windows(words: Column) -> Column:
        def at(grams: Column) -> Column:
            places = F.filter(F.transform(grams, lambda g, i: F.when(g.isin(opening), i)), lambda i: i.isNotNull())

            def window(i: Column) -> Column:
                mine = F.filter(table, lambda t: t["first"] == F.get(grams, i))
                # The window's bigrams are a slice of the text's.
                dice = lambda t: let(
                    F.array_distinct(F.slice(grams, i + 1, t["words"] - 1)), lambda w: 2.0 * F.size(F.array_intersect(w, t["grams"])) / (F.size(w) + t["n"])
                )
                return let(F.transform(mine, lambda t: F.struct(t["license"].alias("license"), dice(t).alias("dice"))), lambda found: best(found, 0))

            return F.flatten(F.transform(places, window))

        return let(_bigrams(words), at)

    # A part has as many bigrams as blanks and line ends at most; parts with fewer than needed are not cut into words.
    gaps = lambda part: F.length(part) - F.length(F.translate(part, " \n", ""))
    parts = F.filter(_parts(F.col("normal")), lambda part: gaps(part) >= smallest)
    found = F.concat(F.flatten(F.transform(parts, of_part)), let(_words(F.col("normal")), of_windows))
    rows = docs.select(docs[key].alias("key"), _normal(docs[text]).alias("normal")).select("key", F.explode(found).alias("m"))
    return (
        rows.groupBy("key", F.col("m.license").alias("license"))
        .agg(F.sum("m.part").alias("n_parts"), F.sum(1 - F.col("m.part")).alias("n_windows"), F.max("m.dice").alias("dice"))
        .withColumnRenamed("key", key)
    )
