"""License scan by Dice coefficient over word bigrams, in DataFrame functions only (operator 8).

A text is cut into blocks: its lines, its paragraphs (between blank lines) and the whole text.
A block is normalised (lower case, every run of other characters than a-z, 0-9 and other letters a blank) and
compared with each licence template: ``2 * common / (a + b)`` over the sets of word bigrams.
Dice >= t needs a size ratio of at least t / (2 - t), so a block is
compared only with templates of fitting size, and bigrams are made only for blocks that are long enough for
some template; those that share no bigram with any template go before the comparison.

Defined results: null or empty text: no blocks, no licence, score 0. A text of one word has no
bigrams. Equal scores: the first template by name. Every input row gives one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.85

#: Notices and short licence texts as their publishers word them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
                   "See the License for the specific language governing permissions and limitations under the License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Proprietary": ["All rights reserved."],
}

SEPARATOR = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATOR, -1), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    """Distinct bigrams of a word array, as strings; none below two words."""
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def template_bigrams(text: str) -> list[str]:
    import re

    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:])))


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, license, score, licenses)``: the best template, its Dice coefficient, and the best templates of all blocks, sorted and comma-joined."""
    grams = [(name, g) for name, texts in sorted(templates.items()) for g in map(template_bigrams, texts) if g]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    least = int(min(len(g) for _, g in grams) * low)
    # distinct bigrams of a block are at most its words less one: shorter blocks than the least size cannot fit
    blocks = F.array_distinct(F.concat(F.split("text", "\n", -1), F.split("text", r"\n[\x20\x09-\x0D]*\n", -1), F.array("text")))
    any_bigram = F.array(*[F.lit(b) for b in dict.fromkeys(b for _, g in grams for b in g)])
    rows = rows.select("doc_id", F.filter(F.transform(blocks, words_of), lambda w: F.size(w) > max(1, least)).alias("blocks"))
    rows = rows.select("doc_id", F.filter(F.transform("blocks", bigrams_of), lambda b: F.arrays_overlap(b, any_bigram)).alias("blocks"))

    def fits(b: Column) -> Column:
        tests = []
        for name, g in grams:
            dice = 2.0 * F.size(F.array_intersect(b, F.array(*[F.lit(x) for x in g]))) / (F.size(b) + len(g))
            sized = (F.size(b) >= len(g) * low) & (F.size(b) <= len(g) * high)
            tests.append(F.when(sized, F.struct((-dice).alias("away"), F.lit(name).alias("name"))))
        best = F.array_min(F.filter(F.array(*tests), lambda s: s.isNotNull() & (s["away"] <= -threshold)))
        return F.when(best.isNotNull(), F.array(best)).otherwise(F.array().cast("array<struct<away:double,name:string>>"))

    rows = rows.select("doc_id", F.array_sort(F.flatten(F.transform("blocks", fits))).alias("found"))
    return rows.select("doc_id", F.get("found", F.lit(0))["name"].alias("license"), F.coalesce(-F.get("found", F.lit(0))["away"], F.lit(0.0)).alias("score"),
                       F.array_join(F.array_sort(F.array_distinct(F.col("found.name"))), ",").alias("licenses"))
