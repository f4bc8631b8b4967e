"""License scan: text units against licence templates by the Dice coefficient over word bigrams.

Texts and templates are normalised alike (lower case, marks and runs of white space to one space) and cut into word bigrams (as sets; a
single word is its own bigram). Units are a document's lines, its whole text, and runs: wherever one of a template's first three
bigrams stands, as many words as the template has, from its first word on. A run finds a notice or a licence inside a longer
text, however it is wrapped and whatever stands beside it.

Two exact bounds spare most of the work. A Dice coefficient of `threshold` needs |A| within `threshold / (2 - threshold)` and its inverse
of |B|, so a line or whole text meets only templates of about its size. And it needs `threshold / (2 - threshold)` of the template's
bigrams, so for each template a few long words that cover more of its bigrams than may be missing are markers: a text or line that
contains no marker at all can match nothing and is not even normalised. It is one pass over the text without a shuffle: the
templates are literals of some kilobytes in the plan.

Defined results for odd input: null, empty or wordless texts have no licence (`license` null, `dice` 0,
`n_matches` and `n_runs` 0); of equal scores the template first in the list wins; every row is scored by itself, so repeated rows repeat
their result. The operator's columns replace input columns of those names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare

# Public licence texts, and the notices that licences tell authors to state.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
}
# Fixed values end.

#: What is not a letter, digit or sign of another script parts words; ASCII only, so that every engine agrees.
MARKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal(text: str) -> str:
    return re.sub(MARKS, " ", text.translate({c: c + 32 for c in range(65, 91)})).strip(" ")


def bigram_set(text: str) -> list[str]:
    words = normal(text).split(" ")
    return list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:]))) or [w for w in words if w]


def template_rows(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    return [(name, bigram_set(t)) for name, each in templates.items() for t in each]


def template_words(templates: dict[str, list[str]] = TEMPLATES) -> list[list[str]]:
    return [normal(t).split(" ") for each in templates.values() for t in each]


def openings(words: list[str]) -> list[str]:
    """A template's first three bigrams, by their place."""
    return [" ".join(p) for p in zip(words[:3], words[1:4])]


def markers(templates: dict[str, list[str]], threshold: float) -> list[str]:
    """Strings of which a text has to contain one to match any template.

    A match has at least `threshold / (2 - threshold)` of a template's bigrams. So words are taken until they touch more bigrams of each template
    than may be missing: always the word that brings all templates nearest to that, words of five letters or more first.
    """
    grams = [list(dict.fromkeys(g)) for _, g in template_rows(templates)]
    need = [int(len(g) * (2 - 2 * threshold) / (2 - threshold)) + 1 for g in grams]
    left = [set(g) for g in grams]
    vocabulary = sorted({w for g in grams for x in g for w in x.split(" ")}, key=lambda w: (len(w) < 5, -len(w), w))
    touched = {w: [{x for x in g if any(w in y for y in x.split(" "))} for g in grams] for w in vocabulary}
    taken: list[str] = []
    while any(n > 0 for n in need):
        usable = [w for w in vocabulary if len(w) >= 5 and any(n > 0 and touched[w][i] & left[i] for i, n in enumerate(need))] or vocabulary
        best = max(usable, key=lambda w: sum(min(n, len(touched[w][i] & left[i])) for i, n in enumerate(need) if n > 0))
        taken.append(best)
        for i in range(len(grams)):
            need[i] -= len(touched[best][i] & left[i])
            left[i] -= touched[best][i]
    return [m for m in taken if not any(o != m and o in m for o in taken)]


def size_bounds(threshold: float) -> tuple[float, float]:
    """The least and largest size of a match, as shares of the template's; a little wider than exact, as the score decides."""
    share = threshold / (2 - threshold)
    return share * (1 - 1e-9), (1 + 1e-9) / share


def _normal(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.trim(F.regexp_replace(F.translate(text, upper, lower), MARKS, " "))


def _bigrams(words: Column) -> Column:
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(n > 1, pairs).otherwise(words))


def scan(
    docs: DataFrame,
    *,
    text: str = "text",
    threshold: float = 0.8,
    templates: dict[str, list[str]] = TEMPLATES,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Adds `license` (best template's name or null), `dice` (its score, else 0), `n_matches` (lines and whole texts that match) and `n_runs` (runs that do).

    `keep` names the input columns to return (all of them by default).
    """
    rows, words_of = template_rows(templates), template_words(templates)
    low, high = size_bounds(threshold)
    sizes = [len(g) for _, g in rows]
    least, most = min(sizes) * low, max(sizes) * high
    table = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("g"), F.lit(len(w)).alias("m"), F.array(*map(F.lit, openings(w))).cast("array<string>").alias("open"))
            for i, ((_, g), w) in enumerate(zip(rows, words_of))
        ]
    )
    signs = markers(templates, threshold)

    # a variable holds what is used more than once: a column named several times would be computed as often
    def marked(x: Column) -> Column:
        return F.exists(F.array(F.lower(x)), lambda low_: reduce(lambda a, b: a | b, [F.contains(low_, F.lit(m)) for m in signs]))

    def scored(grams: Column, t: Column) -> Column:
        return F.struct((F.size(F.array_intersect(grams, t["g"])) * 2.0 / (F.size(grams) + t["n"])).alias("d"), (-t["i"]).alias("o"))

    def best(grams: Column) -> Column:
        n = F.size(grams)
        return F.array_max(F.transform(F.filter(table, lambda t: (t["n"] >= n * low) & (t["n"] <= n * high)), lambda t: scored(grams, t)))

    # lines and the whole text: words of a unit bound its bigrams (n - 1 pairs, or one for a single word; repeats only lower the count)
    def of_units(body: Column) -> Column:
        lines = F.transform(F.filter(F.split(body, "\n"), marked), _normal)
        whole = F.when(F.contains(body, F.lit("\n")), F.array(_normal(body))).otherwise(F.array().cast("array<string>"))
        words = F.transform(F.filter(F.concat(lines, whole), lambda u: u != ""), lambda u: F.split(u, " "))
        sized = F.filter(words, lambda w: F.greatest(F.size(w) - 1, F.lit(1)) >= least)
        grams = F.filter(F.transform(sized, _bigrams), lambda g: (F.size(g) >= least) & (F.size(g) <= most))
        return F.filter(F.transform(grams, best), lambda x: x["d"] >= threshold)

    def starts(words: Column, t: Column) -> Column:
        """Where runs of a template begin, by its openings."""
        at = F.transform(t["open"], lambda o, k: F.transform(F.filter(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)) == o), lambda i: i - k))
        return F.filter(F.array_distinct(F.flatten(at)), lambda i: i >= 1)

    def of_runs(body: Column) -> Column:
        def found(text: Column) -> Column:
            here = F.filter(table, lambda t: F.exists(t["open"], lambda o: F.contains(text, F.concat(F.lit(" "), o, F.lit(" ")))))
            some = F.filter(F.transform(F.filter(F.array(here), lambda x: F.size(x) > 0), lambda x: F.struct(x.alias("t"), F.split(F.trim(text), " ").alias("w"))), lambda x: F.size(x["w"]) > 1)
            runs = F.transform(some, lambda x: F.flatten(F.transform(x["t"], lambda t: F.transform(starts(x["w"], t), lambda i: scored(_bigrams(F.slice(x["w"], i, t["m"])), t)))))
            return F.flatten(runs)

        return F.filter(F.flatten(F.transform(F.array(F.concat(F.lit(" "), _normal(body), F.lit(" "))), found)), lambda x: x["d"] >= threshold)

    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<d:double,o:int>>")
    names = F.array(*[F.lit(name) for name, _ in rows])
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("license", "dice", "n_matches", "n_runs")]
    at = spare("lic_found", docs.columns)
    out = docs.select(*kept, F.when(marked(body), F.struct(of_units(body).alias("units"), of_runs(body).alias("runs"))).alias(at))
    units, runs = (F.coalesce(F.col(at)[c], none) for c in ("units", "runs"))
    top = F.array_max(F.concat(units, runs))
    return out.select(
        *kept,
        F.when(top.isNotNull(), F.element_at(names, 1 - top["o"])).alias("license"),
        F.coalesce(top["d"], F.lit(0.0)).alias("dice"),
        F.size(units).cast("long").alias("n_matches"),
        F.size(runs).cast("long").alias("n_runs"),
    )


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("doc_id",))


def oracle_sql(threshold: float = 0.8) -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def listed(x: list[str]) -> str:
        return f"[{', '.join(map(quoted, x))}]"

    low, high = size_bounds(threshold)
    each = zip(template_rows(), template_words())
    rows = ", ".join(f"({i}, {quoted(n)}, {listed(g)}, {len(w)}, {listed(openings(w))})" for i, ((n, g), w) in enumerate(each))
    norm = r"trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'))"
    grams = "CASE WHEN len(w) > 1 THEN list_distinct([w[k] || ' ' || w[k + 1] FOR k IN range(1, len(w))]) ELSE list_distinct(w) END"
    return f"""
WITH templates(i, name, g, m, open) AS (VALUES {rows}),
units AS (
  SELECT doc_id, u FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS u FROM documents
    UNION ALL SELECT doc_id, text FROM documents WHERE contains(text, chr(10)))),
words AS (SELECT row_number() OVER () AS unit, doc_id, string_split({norm.format("u")}, ' ') AS w FROM units),
grams AS (SELECT unit, doc_id, {grams} AS g FROM words WHERE w <> ['']),
scores AS (
  SELECT unit, doc_id, name, i, 2.0 * len(list_intersect(a.g, t.g)) / (len(a.g) + len(t.g)) AS d
  FROM grams a JOIN templates t ON len(a.g) >= len(t.g) * {low} AND len(a.g) <= len(t.g) * {high}),
best AS (
  SELECT unit, doc_id, arg_max(name, (d, -i)) AS license, max((d, -i)) AS k, max(d) AS d, 'unit' AS kind FROM scores WHERE d >= {threshold} GROUP BY unit, doc_id),
texts AS (SELECT doc_id, {norm.format("text")} AS u FROM documents),
pairs AS (
  SELECT doc_id, i, name, g, m, open, string_split(u, ' ') AS w FROM texts JOIN templates ON
    list_bool_or([contains(' ' || u || ' ', ' ' || o || ' ') FOR o IN open])),
runs AS (
  SELECT doc_id, i, name, g, w[s:s + m - 1] AS w FROM (
    SELECT *, unnest(list_distinct(flatten([[k - o + 1 FOR k IN range(1, len(w)) IF w[k] || ' ' || w[k + 1] = open[o]] FOR o IN range(1, len(open) + 1)]))) AS s FROM pairs)
  WHERE s >= 1),
run_scores AS (SELECT doc_id, name, i, 2.0 * len(list_intersect({grams}, g)) / (len({grams}) + len(g)) AS d FROM runs),
every AS (
  SELECT doc_id, license, k, d, kind FROM best
  UNION ALL SELECT doc_id, name, (d, -i), d, 'run' FROM run_scores WHERE d >= {threshold})
SELECT docs.doc_id, arg_max(license, k) AS license, coalesce(max(d), 0)::DOUBLE AS dice,
  count(*) FILTER (kind = 'unit') AS n_matches, count(*) FILTER (kind = 'run') AS n_runs
FROM documents docs LEFT JOIN every ON every.doc_id = docs.doc_id GROUP BY docs.doc_id
"""


ORACLE_SQL = oracle_sql()
