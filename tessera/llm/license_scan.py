"""License scan, in DataFrame operations only.

Each line, each paragraph and the whole of a text are units: a paragraph is a
header block or a clause however its lines are wrapped, the whole is a licence
file.  Units and templates (short notices, headers, paragraphs of licence texts)
are sparse TF-IDF vectors over lower-case words; a unit whose cosine with a
template reaches the threshold carries that license.  Template weights are
literals of the plan (a fixed, small set), so scoring needs no join and no
shuffle; units that share too few words with any template to reach the threshold
are dropped before they are scored.  A document that is mostly notice is a license
file and covers its directory; documents without a notice of their own take the
license of the nearest ancestor directory that has one, found by joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import named
from tessera.llm.common import checkpoint, split_join

#: What the scan knows unless other templates are given.  Fixed values: the usual
#: short notices, titles and tags, and paragraphs of headers and licence texts.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "MIT License",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. Proprietary and confidential."],
}
WORD = "([a-z0-9]+)"
#: Words of templates that are common in prose.
EVERYDAY = set("a all also an and any are as at basis be been but by can code deal either file files following for form forms found free from general he in is it kind language later law may name names new no not obtain of on one option or other persons rights see so specific style subject such terms that the their these this to under use used was were which whom will with without work you your".split())


Templates = dict[str, list[str]]
Weights = list[tuple[str, dict[str, float]]]


def _words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def word_weights(templates: Templates) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of template words, a license being a document,
    and that of a word which is in none."""
    df = Counter(w for texts in templates.values() for w in {w for text in texts for w in _words_of(text)})
    idf = lambda n: math.log((2 + len(templates)) / (1 + n))
    return {w: idf(n) for w, n in sorted(df.items())}, idf(0)


def template_weights(templates: Templates) -> Weights:
    """(license, unit TF-IDF vector) of every template; n occurrences weigh 1 + ln n."""
    idf, _ = word_weights(templates)
    weights = []
    for name, texts in templates.items():
        for text in texts:
            raw = {w: (1 + math.log(n)) * idf[w] for w, n in sorted(Counter(_words_of(text)).items())}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            weights.append((name, {w: v / norm for w, v in raw.items()}))
    return weights


def _lookup(weights: dict[str, float], word: Column, default: float) -> Column:
    table = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])
    return F.coalesce(F.element_at(table, word), F.lit(default))


def telling_words(weights: Weights, threshold: float) -> list[str]:
    """Words of which a matching unit has at least one.  A unit's cosine with a
    template is at most the norm of the template's weights on shared words, so
    words are taken until, of every template, the others can't reach the threshold
    by themselves: the one that helps the most templates first, everyday words
    last."""
    telling: set[str] = set()
    left = [1.0] * len(weights)
    while open_ := [k for k, x in enumerate(left) if x >= threshold**2 - 1e-9]:
        gain: dict[str, float] = {}
        for k in open_:
            for word, v in weights[k][1].items():
                if word not in telling:
                    gain[word] = gain.get(word, 0.0) + min(v * v, left[k] - threshold**2 + 1e-6)
        word = min(gain, key=lambda w: (w in EVERYDAY or w.isdigit() or len(w) < 2, len(w) < 5, -gain[w], w))
        telling.add(word)
        left = [x - v.get(word, 0.0) ** 2 for x, (_, v) in zip(left, weights)]
    return sorted(telling)


LINE, PARAGRAPH, WHOLE = 0, 1, 2
#: Paragraphs are parted by blank lines.
BLANK = "\n[ \t\r]*\n"
_FOUND = "array<struct<score:double,license:string,kind:int,line:int,words:int>>"


def notices(text: Column, templates: Templates, threshold: float) -> Column:
    """array<struct<score, license, kind, line, words>> of the units that match;
    kind is LINE, PARAGRAPH (of several lines) or WHOLE (of several paragraphs),
    line the number of the unit among those of its kind, from 0."""
    weights = template_weights(templates)
    idf, unknown = word_weights(templates)
    telling = telling_words(weights, threshold)

    def tells(lowered: Column) -> Column:
        """Substrings will do for long words, which is several times faster than a pattern."""
        some = F.lit(False)
        if short := [w for w in telling if len(w) < 5]:
            some = F.rlike(lowered, F.lit("(?<![a-z0-9])(?:" + "|".join(short) + ")(?![a-z0-9])"))
        for word in telling:
            some = F.contains(lowered, F.lit(word)) | some if len(word) >= 5 else some
        return some

    by_word = F.create_map(*[c for w in idf for c in (F.lit(w), F.lit([v.get(w, 0.0) for _, v in weights]))])

    def units(kind: int, pieces: Column) -> Column:
        return F.transform(pieces, lambda s, i: F.struct(F.lit(kind).alias("kind"), i.alias("line"), F.lower(s).alias("s")))

    paragraphs = F.split(text, BLANK)
    several = F.filter(units(PARAGRAPH, paragraphs), lambda h: F.contains(h["s"], F.lit("\n")))
    whole = F.filter(units(WHOLE, F.array(text)), lambda h: F.rlike(h["s"], F.lit(BLANK)))
    likely = F.filter(F.concat(units(LINE, F.split(text, "\n")), several, whole), lambda h: tells(h["s"]))

    def judged(words: Column, unit: Column) -> Column:
        return named(F.array_sort(words), lambda s: named(counted(s), lambda own: named(known_of(own, s), lambda known: top(own, known, unit, F.size(s)))))

    def counted(s: Column) -> Column:
        """Distinct words of a sorted array with their numbers, in linear time."""
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~s[i].eqNullSafe(F.get(s, i - 1)))
        ends = lambda first: F.concat(F.slice(first, 2, F.size(first)), F.array(F.size(s)))
        return named(starts, lambda first: F.zip_with(first, ends(first), lambda a, z: F.struct(s[a].alias("w"), (z - a).alias("n"))))

    def known_of(own: Column, s: Column) -> Column:
        """Words that templates have, with their weights in the unit."""
        few = named(F.array_intersect(s, F.lit(sorted(idf))), lambda k: F.filter(own, lambda x: F.array_contains(k, x["w"])))
        return F.transform(few, lambda x: F.struct(x["w"].alias("w"), x["n"].alias("n"), ((F.log(x["n"]) + 1) * _lookup(idf, x["w"], unknown)).alias("v")))

    def top(own: Column, known: Column, unit: Column, words: Column) -> Column:
        tf = lambda of: F.aggregate(of, F.lit(0.0), lambda s, x: s + F.pow(F.log(x["n"]) + 1, F.lit(2)))
        norm = F.sqrt(F.aggregate(known, F.lit(0.0), lambda s, x: s + x["v"] * x["v"]) + (tf(own) - tf(known)) * unknown**2)
        dots = F.aggregate(known, F.lit([0.0] * len(weights)), lambda s, x: F.zip_with(s, by_word[x["w"]], lambda a, v: a + v * x["v"]))
        best = F.array_max(F.zip_with(dots, F.lit([name for name, _ in weights]), lambda d, name: F.struct(d.alias("score"), name.alias("license"))))
        return named(best, lambda d: F.struct((d["score"] / norm).alias("score"), d["license"].alias("license"), unit["kind"].alias("kind"), unit["line"].alias("line"), words.alias("words")))

    found = F.transform(likely, lambda h: judged(F.regexp_extract_all(h["s"], F.lit(WORD), F.lit(1)), h))
    return F.when(named(F.lower(text), tells), F.filter(found, lambda x: x["score"] >= threshold)).otherwise(F.array().cast(_FOUND))


def license_scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: Templates | None = None, threshold: float = 0.8, file_share: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, path, license, score, unit ("line",
    "paragraph" or "file"; null if inherited), line (0-based number of the line,
    or of the paragraph; null if inherited), origin ("own", "inherited" or
    "none"), directory (the one inherited from, "" the root).

    The best unit decides; ties go to the later license name, then to the file
    over a paragraph over a line, then to the later one.  A file whose matching
    units of one kind hold at least ``file_share`` of its words covers its
    directory; if several do, the best score, then the largest name.
    Null and empty texts have no notice; a null path has no directory and
    inherits nothing.  Repeated rows repeat.  An empty table gives an empty
    result; other columns are ignored.
    """
    base = files.select(files[id_col].cast("long").alias("doc_id"), files[path_col].cast("string").alias("path"), files[text_col].cast("string").alias("text"))
    found = notices(F.coalesce("text", F.lit("")), templates or TEMPLATES, threshold)
    words = F.when(F.size("found") > 0, F.size(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(1)))).otherwise(0)

    def words_in(kind: int) -> Column:
        return F.aggregate("found", F.lit(0), lambda s, x: s + F.when(x["kind"] == kind, x["words"]).otherwise(0))

    held = F.greatest(*(words_in(kind) for kind in (LINE, PARAGRAPH, WHOLE)))
    judged = base.select("doc_id", "path", "text", found.alias("found")).select(
        "doc_id",
        "path",
        F.array_max("found").alias("best"),
        (held >= F.lit(file_share) * F.greatest(words, F.lit(1))).alias("is_file"),
        F.when(F.col("path").isNotNull(), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).alias("dir"),
    )
    judged = checkpoint(judged)  # a few dozen bytes a file, read three times
    covering = judged.where(F.col("is_file") & F.col("best").isNotNull() & F.col("dir").isNotNull())
    covering = covering.groupBy("dir").agg(F.max(F.struct("best.score", "best.license")).alias("cover"))

    wanted = judged.where(F.col("dir").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    ancestors = wanted.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("up")).distinct()
    nearest = ancestors.join(covering.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("up", "cover"), F.length("up")).alias("near"))
    joined = split_join(judged, nearest, "dir", "left")
    own = F.col("best").isNotNull()
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("best.license", "near.cover.license").alias("license"),
        F.coalesce("best.score", "near.cover.score").alias("score"),
        F.when(F.col("best.kind") == LINE, "line").when(F.col("best.kind") == PARAGRAPH, "paragraph").when(F.col("best.kind") == WHOLE, "file").alias("unit"),
        "best.line",
        F.when(own, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("near.up")).alias("directory"),
    )
