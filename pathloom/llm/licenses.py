"""Operator 1: licence scans by Dice coefficient over word bigrams, in DataFrame functions only.

Each line of a text, and the whole text where it has several lines, is normalised (lower case, runs of other characters
than letters and digits are one space) and turned into its set of word bigrams. A template of n bigrams can
reach Dice t only with sets of n * t / (2 - t) to n * (2 - t) / t bigrams, so templates of other sizes are never compared.
A notice or a wrapped licence inside a longer text is found by windows: where a text is too large for a template that no unit
of it matched, but holds at least the template's lower bound of its bigrams, every run of as many words as the template has is
compared, and the best one counts. The text is first taken in stretches that hold each window whole somewhere, and windows are compared only
in those that hold the lower bound by themselves; so a licence in pieces far apart costs one look at each word.

Templates are a list or a table given by the caller, at most MOST_TEMPLATES; they are one literal value, so the plan does not grow with
them. The scan is one pass over the documents without a shuffle. Bigrams are compared by 64-bit hashes. Null and empty texts and lines
of one word match nothing (counts 0, nulls). A very long text is one unit like any other, and its windows are taken one by one. Ties go
to the earlier template, then the earlier unit or window. Every row, a repeated one too, gives a row; an empty table gives an empty
result. Other columns are kept, whatever their names but `__licenses`.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import let

THRESHOLD = 0.8
MOST_TEMPLATES = 5_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The parts that the BSD licences share.
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Licence notices and texts, with their usual short names.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
        "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
]


def _pairs(words: Column) -> Column:
    """Hashes of neighbouring words, in order."""
    less = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, less), F.slice(words, 2, less), lambda x, y: F.xxhash64(x, y))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(_pairs(words))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def _sizes(n: int, threshold: float) -> tuple[int, int]:
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


MATCH = "struct<license string, template int, unit int, word int, dice double>"


def _template_table(spark: SparkSession, templates: list[tuple[str, str]] | DataFrame, threshold: float) -> list[dict]:
    """Of each template: its name, number, count of words, set of bigrams, and the least and largest set it may match."""
    pairs = [tuple(r) for r in templates.select("license", "text").limit(MOST_TEMPLATES + 1).collect()] if isinstance(templates, DataFrame) else templates
    if len(pairs) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    rows = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(pairs)], "k int, license string, text string").select("k", "license", _words(F.col("text")).alias("w"))
    found = sorted(rows.select("k", "license", F.size("w").alias("words"), _bigrams(F.col("w")).alias("b")).collect())
    return [{"license": r.license, "k": r.k, "words": r.words, "b": list(r.b), "low": lo, "high": hi} for r in found if r.b for lo, hi in [_sizes(len(r.b), threshold)]]


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] | DataFrame = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs with a column `__licenses`: an array of (license, template, unit, word, dice) of all matches, by unit and template.

    templates: (license, text) pairs or a table of them. Units are the text's lines from 1, 0 for the whole text, and -1 for a
    window, whose first word is `word` (from 1, else 0).
    """
    table = _template_table(docs.sparkSession, templates, threshold)
    none = F.array().cast(f"array<{MATCH}>")
    if not table:
        return docs.select("*", none.alias("__licenses"))
    known = F.from_json(F.lit(json.dumps(table)), "array<struct<license string, k int, words int, b array<bigint>, low int, high int>>")
    every = F.from_json(F.lit(json.dumps(sorted({x for t in table for x in t["b"]}))), "array<bigint>")
    least = min(t["low"] for t in table)
    text = docs[text_col].cast("string")
    lines = F.split(text, "\n")
    units = F.when(F.size(lines) > 1, F.concat(F.array(text), lines)).otherwise(F.concat(F.array(F.lit("")), lines))
    dice = lambda b, t: 2.0 * F.size(F.array_intersect(b, t["b"])) / (F.size(b) + F.size(t["b"]))
    match = lambda t, unit, word, d: F.struct(t["license"].alias("license"), t["k"].alias("template"), unit.cast("int").alias("unit"), word.cast("int").alias("word"), d.alias("dice"))

    def compare(b: Column, unit: Column) -> Column:
        size = F.size(b)
        fits = F.filter(known, lambda t: (size >= t["low"]) & (size <= t["high"]))
        return F.filter(F.transform(fits, lambda t: match(t, unit, F.lit(0), dice(b, t))), lambda m: m["dice"] >= threshold)

    def windows(w: Column, found: Column) -> Column:
        """The best window of each template that found lacks and that the text may hold."""

        def best(g: Column, t: Column) -> Column:
            # Window s has the pairs s .. s + size - 1; each stretch has those of as many windows as a template has words.
            size, last = t["words"] - 1, F.size(g) - t["words"] + 2
            common = lambda at, n: F.size(F.array_intersect(F.slice(g, at, n), t["b"]))
            score = lambda s: 2.0 * common(s, size) / (F.size(F.array_distinct(F.slice(g, s, size))) + F.size(t["b"]))
            within = lambda i: F.array_max(F.transform(F.sequence(i, F.least(i + size, last)), lambda s: F.struct(score(s).alias("dice"), (-s).alias("s"))))
            stretches = F.transform(F.sequence(F.lit(1), last, t["words"]), lambda i: F.when(common(i, 2 * size) >= t["low"], within(i)))
            return let(F.array_max(stretches), lambda x: match(t, F.lit(-1), -x["s"], x["dice"]))

        def held(g: Column) -> Column:
            own = F.array_distinct(g)
            return F.when(F.size(own) > least, F.struct(g.alias("g"), F.size(own).alias("n"), F.array_intersect(own, every).alias("hits")))

        may = lambda h: F.when(F.size(h["hits"]) >= least, F.filter(known, lambda t: (h["n"] > t["high"]) & (F.size(w) >= t["words"]) & (F.size(F.array_intersect(h["hits"], t["b"])) >= t["low"]) & ~F.exists(found, lambda m: m["template"] == t["k"])))
        tried = let(_pairs(w), lambda g: let(held(g), lambda h: F.transform(may(h), lambda t: best(h["g"], t))))
        return F.coalesce(F.filter(tried, lambda m: m["dice"] >= threshold), none)

    per_unit = lambda u, i: let(_words(u), lambda w: F.when(F.size(w) > least, let(_bigrams(w), lambda b: compare(b, i))).otherwise(none))
    of_units = F.coalesce(F.flatten(F.transform(units, per_unit)), none)
    both = let(of_units, lambda found: F.concat(found, let(_words(F.coalesce(text, F.lit(""))), lambda w: windows(w, found))))
    return docs.select("*", both.alias("__licenses"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", F.col("__licenses").alias("m"))
    best = F.array_max(F.transform("m", lambda m: F.struct(m["dice"].alias("dice"), (-m["template"]).alias("k"), (-m["unit"]).alias("u"), m["license"].alias("license"), m["word"].alias("word"))))
    return found.select("doc_id", F.size("m").cast("long").alias("n_matches"), best.alias("best"), "m").select(
        "doc_id", "n_matches", F.col("best.license").alias("best_license"), F.col("best.dice").alias("best_dice"), (-F.col("best.u")).cast("long").alias("best_line"),
        F.col("best.word").cast("long").alias("best_word"), F.array_join(F.sort_array(F.array_distinct(F.transform("m", lambda m: m["license"]))), ",").alias("licenses"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VALUES = ", ".join(f"({k}, {_quoted(n)}, {_quoted(t)})" for k, (n, t) in enumerate(TEMPLATES))
_SPLIT = r"list_filter(regexp_split_to_array(lower({}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_PAIRS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
QUERIES = {"op1_licenses": op1_licenses}
ORACLES = {
    "op1_licenses": f"""
WITH t AS (SELECT k, name, len(w) AS words, {_PAIRS} AS b FROM (SELECT k, name, {_SPLIT.format("text")} AS w FROM (VALUES {_VALUES}) v(k, name, text))),
u AS (SELECT doc_id, 0 AS unit, text AS line FROM documents WHERE len(string_split(text, chr(10))) > 1
      UNION ALL SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1), unnest(string_split(text, chr(10))) FROM documents),
a AS (SELECT doc_id, unit, {_PAIRS} AS b FROM (SELECT doc_id, unit, {_SPLIT.format("line")} AS w FROM u) WHERE len(w) > 1),
x AS (SELECT doc_id, unit, 0 AS word, k, name, 2.0 * len(list_intersect(a.b, t.b)) / (len(a.b) + len(t.b)) AS dice FROM a JOIN t
      ON len(a.b) BETWEEN ceil(len(t.b) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9) AND floor(len(t.b) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9)),
y AS (SELECT doc_id, w, {_PAIRS} AS b FROM (SELECT doc_id, {_SPLIT.format("text")} AS w FROM documents) WHERE len(w) > 1),
z AS (SELECT y.doc_id, y.w, t.* FROM y JOIN t ON len(y.b) > floor(len(t.b) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9) AND len(y.w) >= t.words AND len(list_intersect(y.b, t.b)) >= ceil(len(t.b) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9)
      WHERE (y.doc_id, t.k) NOT IN (SELECT doc_id, k FROM x WHERE dice >= {THRESHOLD})),
v AS (SELECT doc_id, k, name, b AS tb, word, all_w[word : word + words - 1] AS w FROM (SELECT doc_id, k, name, b, words, w AS all_w, unnest(range(1, len(w) - words + 2)) AS word FROM z)),
s AS (SELECT doc_id, -1 AS unit, word, k, name, 2.0 * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice FROM (SELECT *, {_PAIRS} AS b FROM v)),
m AS (SELECT * FROM x UNION ALL SELECT doc_id, unit, word, k, name, dice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY dice DESC, word) AS o FROM s) WHERE o = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, k, unit) AS o FROM m WHERE dice >= {THRESHOLD}),
g AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n, 0) AS n_matches, r.name AS best_license, CAST(r.dice AS DOUBLE) AS best_dice, CAST(r.unit AS BIGINT) AS best_line, CAST(r.word AS BIGINT) AS best_word, coalesce(g.licenses, '') AS licenses
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND r.o = 1 LEFT JOIN g ON g.doc_id = d.doc_id"""
}
