"""Licence notices and licence texts by the Dice coefficient over word bigrams.

A text is normalised to words (lower case, letters and digits only) and compared
with licence templates: dice = 2 * shared / (bigrams of the passage + bigrams of
the template), over distinct word bigrams.  Passages are the lines, the runs of
lines between blank lines, and, for notices inside a paragraph or a longer text,
every window of a template's own length that starts with one of its bigrams.

A passage of n bigrams can reach a coefficient t only with templates of
t / (2 - t) * n to (2 - t) / t * n bigrams, and must share t / (2 - t) of the
template's.  So a template is first held against the bigrams of the whole text,
then a window against the distance of the bigrams it would need, and only what
is left is compared; prose meets no template at all.

Whole licences are found by the parts that every copy holds: the permission
text, the opening lines, or the notice in their appendix.  Other texts can be
given as ``templates``.  Everything happens inside the row with SQL functions: no
join, no shuffle.  The templates are literals of the plan, a few dozen at most.

Defined cases: null and blank texts have no passage; a passage of one word has
no bigram and matches nothing; a template counts once per text, with its best
passage; of templates with equal coefficients the one with the greater name is
reported, of equal passages the greater one; texts of any length are read whole,
a window costs its template's length; rows are judged by themselves, so repeated
doc_ids do not matter; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
#: (name, notice) as commonly written in files
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: (name, part that every copy of the licence or of its notice holds)
TEXTS = (
    (
        "MIT text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "ISC text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
    ),
    (
        "BSD-3-Clause text",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    (
        "Apache-2.0 text",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
        "REPRODUCTION, AND DISTRIBUTION",
    ),
    (
        "Apache-2.0 notice",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "GPL-3.0 text",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is "
        "permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    (
        "GPL-3.0 notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    (
        "LGPL-3.0 text",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not "
        "allowed.",
    ),
    (
        "MPL-2.0 notice",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
)
TEMPLATES = NOTICES + TEXTS


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(n: int, least: float) -> tuple[int, int]:
    return math.ceil(least / (2 - least) * n - 1e-9), math.floor((2 - least) / least * n + 1e-9)


def _described(templates: Sequence[tuple[str, str]], least: float) -> list[tuple[str, int, int, list[str]]]:
    """(name, least and greatest bigrams of a passage, bigrams) of templates with at least one bigram."""
    named = ((name, template_bigrams(text)) for name, text in templates)
    return [(name, *size_bounds(len(grams), least), grams) for name, grams in named if grams]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id and ``matches``: per template that reaches ``least`` an array entry (dice, template, passage) of its best passage."""
    known = _described(templates, least)
    rows = [
        F.struct(
            F.lit(name).alias("name"), F.lit(low).alias("low"), F.lit(high).alias("high"),
            F.array(*map(F.lit, grams)).alias("grams"),
        )
        for name, low, high, grams in known
    ]
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = r"array_remove(split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' '), ' '), '')"
    paired = "transform(slice({0}, 1, size({0}) - 1), (w, i) -> concat(w, ' ', get({0}, i + 1)))"
    staged = docs.select(
        "doc_id",
        text.alias("_text"),
        F.expr(worded.format("coalesce(text, '')")).alias("_words"),
        F.array(*rows).alias("_templates"),
    )
    staged = staged.withColumn("_grams", F.expr(f"if(size(_words) < 2, array(), {paired.format('_words')})"))
    staged = staged.withColumn(
        "_known", F.array_intersect("_grams", F.array(*[F.lit(g) for g in sorted({g for t in known for g in t[3]})]))
    )
    # templates of which the whole text holds enough
    staged = staged.withColumn(
        "_near",
        F.expr(
            """if(size(_known) = 0, slice(_templates, 1, 0),
                  filter(_templates, t -> size(_known) >= t.low and size(array_intersect(_known, t.grams)) >= t.low))"""
        ),
    )
    # lines and blocks
    staged = staged.withColumn(
        "_passages",
        F.when(
            F.size("_near") > 0,
            F.concat(
                F.split("_text", "\n"),
                F.filter(F.split("_text", r"\n[\x20\x09-\x0D]*\n"), lambda p: F.instr(p, "\n") > 0),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
    staged = staged.withColumn(
        "_pieces",
        F.expr(
            f"""filter(transform(filter(transform(_passages, p -> struct({worded.format("p")} as words)), x -> size(x.words) > 1),
                  x -> struct(array_distinct({paired.format("x.words")}) as grams, array_join(x.words, ' ') as passage)),
                x -> size(x.grams) > 0)"""
        ),
    )
    # windows: positions of a template's bigrams, then those that have enough others near
    staged = staged.withColumn(
        "_hits",
        F.expr(
            """transform(_near, t -> struct(t as t,
                 filter(sequence(1, greatest(size(_grams), 1)), i -> array_contains(t.grams, get(_grams, i - 1))) as hits))"""
        ),
    )
    staged = staged.withColumn(
        "_starts",
        F.expr(
            """transform(_hits, x -> struct(x.t as t,
                 filter(x.hits, (i, k) -> get(x.hits, k + x.t.low - 1) - i < size(x.t.grams)) as starts))"""
        ),
    )
    dice = "2.0D * size(array_intersect({0}, t.grams)) / (size({0}) + size(t.grams))"
    staged = staged.withColumn(
        "_found",
        F.expr(
            f"""transform(_starts, x -> struct(x.t as t, concat(
                  transform(filter(_pieces, y -> size(y.grams) between x.t.low and x.t.high),
                    y -> struct({dice.format("y.grams").replace("t.grams", "x.t.grams")} as dice, y.passage as passage)),
                  transform(transform(x.starts, i -> struct(i as i, array_distinct(slice(_grams, i, size(x.t.grams))) as grams)),
                    y -> struct({dice.format("y.grams").replace("t.grams", "x.t.grams")} as dice,
                                array_join(slice(_words, y.i, size(x.t.grams) + 1), ' ') as passage))) as all))"""
        ),
    )
    return staged.select(
        "doc_id",
        F.expr(
            f"""filter(transform(_found, x -> struct(array_max(x.all) as best, x.t.name as name)),
                  x -> x.best.dice >= {least}D)"""
        ).alias("_best"),
    ).select(
        "doc_id",
        F.expr("transform(_best, x -> struct(x.best.dice as dice, x.name as template, x.best.passage as passage))").alias("matches"),
    )


def report(docs: DataFrame) -> DataFrame:
    """Per document: the number of matching templates, and the best of them."""
    found = scan(docs)
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["dice"], m["template"])))
    return found.select(
        "doc_id",
        F.size("matches").cast("bigint").alias("n_matches"),
        best["template"].alias("license"),
        best["dice"].alias("dice"),
    )


def _sql() -> str:
    values = []
    for name, low, high, grams in _described(TEMPLATES, LEAST):
        quoted = ", ".join("'" + g + "'" for g in grams)
        values.append(f"('{name}', {low}, {high}, [{quoted}])")
    worded = r"list_filter(string_split(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
    paired = "list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])"
    dice = "2.0::DOUBLE * len(list_intersect(grams, tgrams)) / (len(grams) + len(tgrams))"
    return rf"""
WITH t(name, low, high, tgrams) AS (VALUES {", ".join(values)}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT rid, unnest(string_split(text, chr(10))) AS p FROM d
      UNION ALL SELECT rid, p FROM (SELECT rid, unnest(string_split_regex(text, '\n[\x20\x09-\x0D]*\n')) AS p FROM d) WHERE contains(p, chr(10))),
w AS (SELECT rid, {worded.format("p")} AS ws FROM p),
g AS (SELECT rid, list_distinct({paired}) AS grams FROM w WHERE len(ws) > 1),
m AS (SELECT rid, name, {dice} AS dice FROM g JOIN t ON len(grams) BETWEEN low AND high),
a AS (SELECT rid, {paired} AS grams FROM (SELECT rid, {worded.format("text")} AS ws FROM d) WHERE len(ws) > 1),
e AS (SELECT rid, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i FROM a),
h AS (SELECT rid, name, tgrams, i, lead(i, low - 1) OVER (PARTITION BY rid, name ORDER BY i) AS last
      FROM e JOIN (SELECT name, low, tgrams, unnest(tgrams) AS gram FROM t) USING (gram)),
x AS (SELECT rid, name, tgrams, list_distinct(list_slice(a.grams, i, i + len(tgrams) - 1)) AS grams
      FROM h JOIN a USING (rid) WHERE last - i < len(tgrams)),
r AS (SELECT * FROM m UNION ALL SELECT rid, name, {dice} FROM x),
b AS (SELECT rid, count(DISTINCT name) AS n, max(struct_pack(dice := dice, name := name)) AS best FROM r WHERE dice >= {LEAST} GROUP BY rid)
SELECT doc_id, coalesce(n, 0) AS n_matches, best.name AS license, best.dice AS dice FROM d LEFT JOIN b USING (rid)
"""


SQL = _sql()
