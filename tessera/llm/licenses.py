"""Operator 10, license scan by an exact set-similarity join with license templates.

A template is a paragraph of a public license text or of the notice it asks for. Its blocks in a
text are windows of words: with L words in the template (repeats counted), one window of 2 L words
begins at every L-th word, so each passage of up to L + 1 words lies whole in a window, however its
lines are wrapped. A template meets a window that holds at least ``threshold`` of its distinct
words, every one of its ``must`` words and none of its ``not`` words; these tell apart
licenses that differ in one word or number. Of templates of one family that meet overlapping
windows only those with the most shared words count.

The words of all templates are ranked by their frequency in the whole corpus, rarest first. Of a
template with m distinct words that must share k, a window that meets it holds one of the first
m - k + 1 (prefix filter) and has at least k words (length filter); where the first word they share
is the i-th of the template and the j-th of the window's ranked words, at most 1 + min(m - i, n - j)
words can be shared (positional filter, i and j from 1, n of the window's words ranked). What
passes is compared exactly.

Beside the join, fixed phrases count where their words stand consecutively, as base labels.

Each text is split into words once: one projection keeps its counts, phrase places and the places
of the templates' words, and all else reads that. Templates are a small fixed library, so their
index is a literal and the join is a look-up in the row: no text, no window and no key is
shuffled, so no key can be hot. Corpus frequencies are at most one row per word of the library.

Nulls: a null text counts as empty: no words, null positions, empty labels, score 0. A null
doc_id stays. Repeated rows get the same result each. Texts of any length are split whole, never
cut. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm._shared import column, let, lower_ascii, table, written

THRESHOLD = 0.8
#: Phrases and their base labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Fixed values: (family, label, must words, not words, text), from the public texts of the licenses and their usual notices.
TEMPLATES = (
    ("mit", "mit", "mit license", "", "Released under the MIT License."),
    ("mit", "mit", "mit license", "", "Licensed under the MIT License."),
    ("mit", "mit", "mit license", "", "This project is licensed under the terms of the MIT license."),
    ("mit", "mit", "permission granted free charge sublicense", "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "mit", "above copyright notice permission substantial portions", "", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "isc", "permission use copy modify fee granted", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "bsd", "bsd license", "", "Released under the BSD License."),
    ("bsd", "bsd", "bsd license", "", "Licensed under the BSD License."),
    ("bsd", "bsd", "bsd style license found", "", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "bsd", "redistribution source binary forms modification", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "bsd-3", "neither name endorse promote prior written", "", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("apache", "apache-2", "apache license version 2", "", "Licensed under the Apache License, Version 2.0."),
    ("apache", "apache-2", "apache license version 2", "", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "apache-2", "required applicable law basis warranties", "", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "gpl-3", "general public license 3", "lesser affero library 2", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "gpl-2", "general public license 2", "lesser affero library 3", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl", "gpl-3", "gnu general public license 3", "lesser affero library", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "gpl-2", "gnu general public license 2", "lesser affero library", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl", "lgpl", "gnu lesser general public license", "affero", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("gpl", "lgpl", "lesser general public license", "affero", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("gpl", "agpl-3", "gnu affero general public license", "lesser", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "agpl-3", "affero general public license", "lesser", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("cc", "cc-by", "creative commons attribution", "noncommercial sharealike noderivatives noderivs alike non", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc", "cc-by-sa", "creative commons attribution sharealike", "noncommercial noderivatives noderivs non", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc", "cc-by-nc", "creative commons attribution noncommercial", "sharealike noderivatives noderivs alike", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc", "cc-by-nd", "creative commons attribution noderivatives", "noncommercial sharealike alike non", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc", "cc-by-nc-sa", "creative commons attribution noncommercial sharealike", "noderivatives noderivs", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc", "cc-by-nc-nd", "creative commons attribution noncommercial noderivatives", "sharealike alike", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc", "cc-by-nc", "cc by nc", "sa nd", "Licensed under CC BY-NC 4.0."),
    ("cc", "cc-by-sa", "cc by sa", "nc nd", "Licensed under CC BY-SA 4.0."),
    ("cc", "cc-by", "licensed cc by", "nc sa nd", "Licensed under CC BY 4.0."),
    ("cc0", "cc0", "creative commons public domain", "", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide under the Creative Commons CC0 Public Domain Dedication."),
    ("mpl", "mpl-2", "mozilla public license 2", "", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl", "mpl-2", "mozilla public license 2", "", "Licensed under the Mozilla Public License, version 2.0."),
    ("epl", "epl-2", "eclipse public license 2", "", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("unlicense", "unlicense", "free unencumbered public domain", "", "This is free and unencumbered software released into the public domain."),
    ("zlib", "zlib", "altered source misrepresented original", "", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("boost", "bsl-1", "boost software license", "", "Distributed under the Boost Software License, Version 1.0."),
    ("warranty", "as-is", "provided as warranty merchantability", "", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("reserved", "all-rights-reserved", "all rights reserved", "", "All rights reserved."),
    ("reserved", "all-rights-reserved", "publication reproduced permission", "", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."),
)

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words_of(text: str) -> list[str]:
    return [w for w in re.split(_BETWEEN, text.lower()) if w]


class Library:
    """Templates by number, with their words as numbers of the vocabulary."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.vocabulary = sorted({w for *_, must, never, text in templates for w in (*_words_of(text), *must.split(), *never.split())})
        code = {w: i for i, w in enumerate(self.vocabulary)}
        self.families = [t[0] for t in templates]
        self.labels = [t[1] for t in templates]
        self.must = [sorted(code[w] for w in t[2].split()) for t in templates]
        self.never = [sorted(code[w] for w in t[3].split()) for t in templates]
        self.lengths = [len(_words_of(t[4])) for t in templates]
        self.words = [sorted({code[w] for w in _words_of(t[4])}) for t in templates]
        self.needed = [math.ceil(threshold * len(t) - 1e-9) for t in self.words]


def _spaced(text: Column) -> Column:
    """Lower-case words, a blank before and after each run of words; a blank alone if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), lower_ascii(F.coalesce(text, F.lit(""))), F.lit(" ")), _BETWEEN, " ")


def _places(phrase: str, label: str):
    """A function from a text's words to (start, label) of each place where the phrase stands."""
    parts = phrase.split(" ")

    def places(words: Column) -> Column:
        def here(i: Column) -> Column:
            return reduce(and_, [F.get(words, i + k) == F.lit(part) for k, part in enumerate(parts)])

        at = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    return places


def occurrences(documents: DataFrame, library: Library, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, places, hits)``; places: (start, label) of every phrase, hits: (at, code) of every word of the library."""
    vocabulary = F.lit(library.vocabulary)
    spaced = documents.select(column(id_col).cast("long").alias("doc_id"), _spaced(column(text_col)).alias("s"))
    n_words = F.length("s") - F.length(F.translate("s", " ", "")) - 1
    none = F.array().cast("array<struct<at:int,label:string>>")

    def of_words(words: Column) -> Column:
        found = [F.when(F.col("s").contains(f" {phrase} "), _places(phrase, label)(words)).otherwise(none) for phrase, label in PHRASES.items()]
        at = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(library.vocabulary), i)))
        hits = F.transform(at, lambda i: F.struct(i.alias("at"), (F.array_position(vocabulary, F.get(words, i)) - 1).cast("int").alias("code")))
        return F.struct(F.concat(*found).alias("places"), hits.alias("hits"))

    words = F.split(F.btrim("s"), " ")
    empty = F.struct(none.alias("places"), F.array().cast("array<struct<at:int,code:int>>").alias("hits"))
    return spaced.select("doc_id", n_words.cast("long").alias("n_words"), F.when(n_words > 0, let(words, of_words)).otherwise(empty).alias("w")).select("doc_id", "n_words", "w.*")


def frequencies(found: DataFrame) -> dict[int, int]:
    """How often each word of the library stands in the texts, over all of them."""
    counted = found.select(F.explode("hits.code").alias("code")).groupBy("code").count()
    return {r["code"]: r["count"] for r in counted.collect()}  # one row per word of the library at most


def _fixed(value: list, kind: str) -> Column:
    """A nested list as one literal: written as JSON and read once, when the plan's constants are folded."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def matches(library: Library, often: dict[int, int], hits: Column, n_words: Column) -> Column:
    """(family, lo, hi, template, label, shared, containment) of every window that a template meets, once each.

    A match is found where the first word it shares stands first in the window, so no two need be compared to tell them apart.
    """
    ranked = sorted(range(len(library.vocabulary)), key=lambda c: (often.get(c, 0), library.vocabulary[c]))
    rank = {c: i for i, c in enumerate(ranked)}
    index: list[list[tuple]] = [[] for _ in ranked]
    for t, words in enumerate(library.words):
        order = sorted(words, key=rank.get)
        for i, code in enumerate(order[: len(order) - library.needed[t] + 1], 1):
            index[code].append((t, i, library.lengths[t]))
    starts = _fixed([[dict(zip(("t", "i", "len"), row, strict=True)) for row in rows] for rows in index], "array<array<struct<t:int,i:int,len:int>>>")
    codes = lambda lists: _fixed(lists, "array<array<int>>")
    ranks, must, never = codes([sorted(rank[c] for c in w) for w in library.words]), codes(library.must), codes(library.never)
    needed, rank_of = F.lit(library.needed), F.lit([rank[c] for c in range(len(rank))])
    families, labels = F.lit(library.families), F.lit(library.labels)

    def windows(h: Column) -> Column:
        def both(x: Column) -> Column:
            last = F.floor(h["at"] / x["len"]).cast("int")
            return F.transform(F.filter(F.array(last - 1, last), lambda b: b >= 0), lambda b: F.struct(x["t"].alias("t"), x["i"].alias("i"), h["x"].alias("x"), h["at"].alias("at"), (b * x["len"]).alias("lo"), ((b + 2) * x["len"]).alias("hi")))

        return F.flatten(F.transform(F.get(starts, h["code"]), both))

    def compared(p: Column) -> Column:
        k, ts = F.get(needed, p["t"]), F.get(ranks, p["t"])
        wide = p["hi"] - p["lo"]  # a window's words, so no more of its hits lie on either side of one of them
        around = F.slice(hits, F.greatest(p["x"] - wide, F.lit(0)) + 1, 2 * wide + 1)
        inside = F.filter(around, lambda h: (h["at"] >= p["lo"]) & (h["at"] < p["hi"]))

        def once(held: Column) -> Column:
            code = F.get(hits, p["x"])["code"]
            again = F.exists(held, lambda h: (h["code"] == code) & (h["at"] < p["at"]))  # then that place gives the same match
            return F.when(~again, let(F.array_distinct(F.transform(held, lambda h: h["code"])), exact))

        def exact(own: Column) -> Column:
            block = F.array_sort(F.transform(own, lambda c: F.get(rank_of, c)))
            first = F.get(ts, p["i"] - 1)

            def shared(mine: Column) -> Column:
                close = 1 + F.least(F.size(ts) - p["i"], F.size(mine) - F.array_position(mine, first).cast("int")) >= k
                both = F.array_intersect(mine, ts)
                right = (F.size(F.array_except(F.get(must, p["t"]), own)) == 0) & ~F.arrays_overlap(F.get(never, p["t"]), own)
                met = close & right & (F.size(both) >= k) & (F.get(both, F.lit(0)) == first)
                row = F.struct(F.get(families, p["t"]).alias("family"), p["lo"].alias("lo"), p["hi"].alias("hi"), p["t"].alias("t"), F.get(labels, p["t"]).alias("label"), F.size(both).alias("shared"), (F.size(both) / F.size(ts)).alias("containment"))
                return F.when(met, row)

            return let(block, shared)

        return F.when(F.least(n_words, p["hi"].cast("long")) - p["lo"] >= k, let(inside, once))

    placed = F.transform(hits, lambda h, x: F.struct(h["at"].alias("at"), h["code"].alias("code"), x.alias("x")))
    starters = F.filter(placed, lambda h: F.size(F.get(starts, h["code"])) > 0)
    return F.array_compact(F.transform(F.flatten(F.transform(starters, windows)), compared))


def _best(library: Library, met: Column) -> Column:
    """Matches but for those that overlap one of their family with more shared words.

    A template has one window at every L-th word, so sorted by family and place a match has at most as many neighbours that
    it can overlap as the family's windows begin within the length of its longest; only those are looked at.
    """
    lengths: dict[str, list[int]] = {}
    for family, length in zip(library.families, library.lengths, strict=True):
        lengths.setdefault(family, []).append(length)
    near = max(sum(2 * max(each) // n + 1 for n in each) for each in lengths.values())

    def of(ordered: Column) -> Column:
        def left(m: Column, i: Column) -> Column:
            around = F.slice(ordered, F.greatest(i - near, F.lit(0)) + 1, 2 * near + 1)
            beaten = F.exists(around, lambda o: (o["family"] == m["family"]) & (o["shared"] > m["shared"]) & (o["lo"] < m["hi"]) & (m["lo"] < o["hi"]))
            return ~beaten

        return F.filter(ordered, left)

    return let(F.array_sort(met), of)


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of every row.

    score: 1 where a phrase stands, else the largest containment of a template that counts, else 0.
    """
    library = Library(threshold=threshold)
    found = written(occurrences(documents, library, id_col, text_col), "licenses")
    met = matches(library, frequencies(found), F.col("hits"), F.col("n_words"))
    rows = found.withColumn("met", _best(library, met))
    labels = F.array_distinct(F.col("places.label"))
    more = F.array_distinct(F.concat(labels, F.col("met.label")))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.at").cast("long").alias("first_word"),
        F.array_max("places.at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(more), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("met.containment"), F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Every window of every template compared, without filters."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"list_filter(string_split_regex({lower}, '{_BETWEEN}'), lambda w: w <> '')"
    rows = []
    for n, (family, label, must, never, text) in enumerate(TEMPLATES):
        ws = _words_of(text)
        lists = ", ".join(f"{x!r}::VARCHAR[]" for x in (sorted(set(ws)), must.split(), never.split()))
        rows.append(f"({n}, '{family}', '{label}', {len(ws)}, {lists})")
    starts = []
    for phrase, label in PHRASES.items():
        parts = phrase.split(" ")
        same = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        starts.append(f"list_transform(list_filter(range(0, len(w)), lambda i: {same}), lambda i: {{'at': i, 'label': '{label}'}})")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
base AS (SELECT r, doc_id, len(w) AS n_words, list_concat(list_concat({starts[0]}, {starts[1]}), {starts[2]}) AS places FROM d),
templates(t, family, label, len, ts, must, never) AS (VALUES {", ".join(rows)}),
windows AS (
  SELECT r, t, family, label, ts, must, never, b * len AS lo, (b + 2) * len AS hi, list_distinct(w[b * len + 1 : (b + 2) * len]) AS ws
  FROM (SELECT r, w, t, family, label, len, ts, must, never, unnest(range(0, (len(w) + len - 1) // len)) AS b FROM d, templates WHERE list_has_all(w, must))
),
met AS (
  SELECT r, family, label, lo, hi, len(list_intersect(ws, ts)) AS shared, len(list_intersect(ws, ts)) / len(ts)::DOUBLE AS containment FROM windows
  WHERE len(list_intersect(ws, ts)) >= ceil({THRESHOLD} * len(ts) - 1e-9) AND list_has_all(ws, must) AND NOT list_has_any(ws, never)
),
left_over AS (SELECT * FROM met m WHERE NOT EXISTS (SELECT 1 FROM met o WHERE o.r = m.r AND o.family = m.family AND o.shared > m.shared AND o.lo < m.hi AND m.lo < o.hi)),
best AS (SELECT r, list(DISTINCT label) AS met, max(containment) AS best FROM left_over GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base,
  list_min(list_transform(places, lambda p: p.at))::BIGINT AS first_word, list_max(list_transform(places, lambda p: p.at))::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda p: p.label), coalesce(met, [])))), ','), '') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM base LEFT JOIN best USING (r)
"""


SQL = _sql()
