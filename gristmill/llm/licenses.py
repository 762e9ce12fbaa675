"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

DataFrame functions only, in the projection of the scan: no join, no shuffle, no Python. Text is lower-cased (A-Z), all
but a-z and 0-9 become blanks. Units of a document are its lines, its paragraphs (parted by blank lines), its whole, and
windows: wherever a bigram of a template's prefix stands, as many words as the template has, placed so that the bigram
stands where the template has it. So notices within a longer line and notices wrapped over lines are found.
A unit goes on if its number of distinct bigrams can reach the threshold with some template, and if it shares a bigram
with the templates' prefixes: of a template with n bigrams at least ceil(n*t/(2-t)) must be shared, so any
n - ceil(n*t/(2-t)) + 1 of them hold one that is. A text that holds no bigram of any prefix is not cut into units at
all. What is left is compared with the templates within size bounds.

Edge cases: null and empty text has no unit and no match; ties of score go to the later template name; units of equal
words count once; a text of any length is one value of one row, whose windows are scored in its task; repeated rows are judged alike; an empty table gives no rows; only the named text column is read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.values import let

THRESHOLD = 0.8

# The customary notices of public licences, and the bodies of the short ones.
TEMPLATES: dict[str, str] = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD disclaimer": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause body": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC body": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "MIT body": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense body": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def places(templates: dict[str, str], threshold: float) -> dict[str, list[tuple[int, int]]]:
    """For each bigram of a prefix, the (place, words of the template) of each of its places in templates."""
    out: dict[str, set[tuple[int, int]]] = {}
    for text in templates.values():
        words, own = template_words(text), set(prefix(template_bigrams(text), threshold))
        for i in range(len(words) - 1):
            if (b := f"{words[i]} {words[i + 1]}") in own:
                out.setdefault(b, set()).add((i, len(words)))
    return {b: sorted(found) for b, found in sorted(out.items())}


def prefix(bigrams: list[str], threshold: float) -> list[str]:
    """Bigrams of which every unit that reaches the threshold has one; the longest, as these are rare in prose."""
    need = math.ceil(len(bigrams) * threshold / (2 - threshold) - 1e-9)
    return sorted(bigrams, key=lambda b: (-len(b), b))[: len(bigrams) - need + 1]


def bigram_pattern(bigrams: set[str]) -> str:
    """Finds any of the bigrams between blanks and line ends; one branch a letter, then one a first word."""
    by_letter: dict[str, dict[str, list[str]]] = {}
    for b in sorted(bigrams):
        first, second = b.split(" ")
        by_letter.setdefault(first[0], {}).setdefault(first[1:], []).append(second)
    letters = [f"{c}(?:{'|'.join(f'{x}[ \\n]+(?:{'|'.join(own)})' for x, own in words.items())})" for c, words in by_letter.items()]
    return rf"(?:^|[ \n])(?:{'|'.join(letters)})(?:[ \n]|$)"


def _words(unit: Column) -> Column:
    return F.filter(F.split(unit, "[ \n]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """The bigrams at each place but the last."""
    return F.filter(F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())


def matches(text: Column, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> Column:
    """array<struct<score, license>>: the best template of each distinct unit of ``text`` that reaches the threshold."""
    own = {k: template_bigrams(v) for k, v in (templates or TEMPLATES).items()}
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = math.ceil(min(map(len, own.values())) * low - 1e-9), math.floor(max(map(len, own.values())) * high + 1e-9)
    prefixes = {b for v in own.values() for b in prefix(v, threshold)}
    rare, pattern, none = F.array(*map(F.lit, sorted(prefixes))), bigram_pattern(prefixes), F.array().cast("array<string>")
    known = places(templates or TEMPLATES, threshold)
    stands = F.create_map(*[x for bigram, at in known.items() for x in (F.lit(bigram), F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("n")) for i, n in at]))])
    table = F.array(*[F.struct(F.lit(k).alias("license"), F.array(*map(F.lit, v)).alias("own")) for k, v in sorted(own.items())])

    def best(s: Column) -> Column:
        within = F.filter(table, lambda t: F.size(s).between(F.ceil(F.size(t["own"]) * low - 1e-9), F.floor(F.size(t["own"]) * high + 1e-9)))
        scored = F.transform(
            within,
            lambda t: F.struct(
                (F.size(F.array_intersect(s, t["own"])) * 2.0 / (F.size(s) + F.size(t["own"]))).alias("score"),
                t["license"].alias("license"),
            ),
        )
        return F.array_max(scored)

    def windows(held: Column) -> Column:
        """Runs of words (w) around the bigrams of prefixes among the text's (p)."""
        of = lambda i, t: F.array_join(F.slice(held["w"], F.greatest(i + 1 - t["at"], F.lit(1)), t["n"]), " ")
        at = lambda bigram: F.filter(F.transform(held["p"], lambda p, i: F.when(p == bigram, i)), lambda i: i.isNotNull())
        around = lambda bigram: F.flatten(F.transform(at(bigram), lambda i: F.transform(stands[bigram], lambda t: of(i, t))))
        return F.flatten(F.transform(F.array_intersect(held["p"], rare), around))

    def found(plain: Column) -> Column:
        whole = F.array_distinct(F.concat(F.split(plain, "\n"), F.split(plain, "\n[ \n]*\n"), F.array(plain)))
        cut = let(_words(plain), lambda w: let(F.struct(w.alias("w"), _pairs(w).alias("p")), windows))
        units = F.array_distinct(F.concat(F.transform(whole, lambda u: F.array_join(_words(u), " ")), cut))
        sets = F.transform(F.when(plain.rlike(pattern), units).otherwise(none), lambda u: F.array_distinct(_pairs(_words(u))))
        fit = F.filter(sets, lambda s: F.size(s).between(least, most) & F.arrays_overlap(s, rare))
        return F.filter(F.transform(fit, best), lambda m: m["score"] >= threshold)

    # letters of other scripts are blanks either way, so only A-Z need lowering
    return let(F.lower(F.regexp_replace(text, "[^A-Za-z0-9\n]+", " ")), found)


def scan(docs: DataFrame, text: str = "text", name: str = "matches") -> DataFrame:
    """``docs`` with an array column ``name`` of its matches."""
    return docs.withColumn(name, matches(F.col(text)))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license (best match or null), score (0 if none), n_matches (distinct units), licenses (sorted, joined)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).select("doc_id", "matches", F.array_max("matches").alias("best"))
    return found.select(
        "doc_id",
        F.col("best.license").alias("license"),
        F.round(F.coalesce(F.col("best.score"), F.lit(0.0)), 6).alias("score"),
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",").alias("licenses"),
    )


def _sql() -> str:
    rows = ", ".join(f"('{k}', [{', '.join(repr(b) for b in template_bigrams(v))}])" for k, v in sorted(TEMPLATES.items()))
    stands = ", ".join(f"('{b}', {i}, {n})" for b, at in places(TEMPLATES, THRESHOLD).items() for i, n in at)
    return rf"""
WITH templates(license, own) AS (VALUES {rows}),
stands(b, place, n) AS (VALUES {stands}),
d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '[^a-z0-9\n]+', ' ', 'g') AS plain FROM documents),
a AS (SELECT r, list_filter(regexp_split_to_array(plain, '[ \n]+'), lambda x: x <> '') AS w FROM d),
i AS (SELECT r, w, unnest(range(1, len(w))) AS i FROM a),
c AS (SELECT r, array_to_string(w[greatest(i - place, 1) : greatest(i - place, 1) + n - 1], ' ') AS unit FROM i JOIN stands ON b = w[i] || ' ' || w[i + 1]),
l AS (SELECT r, unnest(list_concat(string_split(plain, chr(10)), regexp_split_to_array(plain, '\n[ \n]*\n'), [plain])) AS unit FROM d),
u AS (SELECT DISTINCT r, unit FROM (
  SELECT r, array_to_string(list_filter(regexp_split_to_array(unit, '[ \n]+'), lambda x: x <> ''), ' ') AS unit FROM l UNION ALL SELECT r, unit FROM c)),
w AS (SELECT r, unit, string_split(unit, ' ') AS w FROM u),
s AS (SELECT r, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM w WHERE len(w) > 1),
m AS (SELECT r, unit, license, len(list_intersect(s, own)) * 2.0::DOUBLE / (len(s) + len(own)) AS score FROM s, templates
  WHERE len(s) <= 4 * len(own) AND len(own) <= 4 * len(s)),
b AS (SELECT r, unit, score, license FROM m WHERE score >= 0.8
  QUALIFY row_number() OVER (PARTITION BY r, unit ORDER BY score DESC, license DESC) = 1),
g AS (SELECT r, arg_max(license, (score, license)) AS license, max(score) AS score, count(*) AS n,
  array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses FROM b GROUP BY r)
SELECT doc_id, license, round(coalesce(score, 0), 6) AS score, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN g USING (r)
"""


OP10_SQL = _sql()
