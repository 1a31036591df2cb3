"""Licence scan by a positional rare-token index, with DataFrame functions only.

Templates are whole licence texts and notices with a mandatory key phrase inside, and short forms. Document frequencies of the key phrases' words are counted over all documents. The index has, for each template,
postings (template, position) of its key phrase's words of highest IDF. Each file's index words are looked up; postings that agree on the same start are intersected; and at each start that all of a
template's index words agree on, its mandatory key phrase must stand word for word. Base phrases are templates that are mandatory as a whole, so
every place of theirs is found: a place has all words of the phrase, its rarest ones too. The score of a start is the share of the template's
words that stand at their relative positions, so a whole licence scores 1 and a mention of its key phrase little; a file's score is its best one.

Defined results: a null or empty text has no words, no places, empty labels and score 0; repeated rows are scanned each for itself; an empty table
gives no rows; other columns are not read. Only the counts (one row a template word) reach the driver.
"""

from __future__ import annotations

import math
import re
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Public licence texts and notices, the parts that stay the same in each use.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment
in perpetuity of all present and future rights to this software under copyright law."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
#: Label, whether it is a base phrase, template text, mandatory key phrase.
TEXTS = [
    ("mit", True, "mit license", "mit license"),
    ("apache", True, "apache license", "apache license"),
    ("gpl", True, "general public license", "general public license"),
    ("mit-notice", False, MIT, "permission is hereby granted free of charge"),
    ("apache-2.0", False, APACHE, "apache license version 2 0"),
    ("gpl-notice", False, GPL, "under the terms of the gnu general public license"),
    ("gpl-2.0", False, "gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", False, "gnu general public license version 3", "general public license version 3"),
    ("lgpl", False, "gnu lesser general public license", "lesser general public license"),
    ("agpl", False, "gnu affero general public license", "affero general public license"),
    ("mpl-2.0", False, MPL, "mozilla public license"),
    ("bsd", False, f"{BSD} {BSD_END}", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", False, f"{BSD} {BSD_3} {BSD_END}", "neither the name of the copyright holder nor the names of its contributors"),
    ("isc", False, ISC, "for any purpose with or without fee is hereby granted"),
    ("zlib", False, ZLIB, "the origin of this software must not be misrepresented"),
    ("unlicense", False, UNLICENSE, "free and unencumbered software"),
    ("cc-by-4.0", False, "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", False, "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", False, "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", False, "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc0-1.0", False, "cc0 1 0 universal", "cc0 1 0"),
]
#: What stands between words once A-Z count as letters.
_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The templates as words, read by the same rule as files.
TEMPLATES = [(label, base, re.sub(_BREAKS, " ", text).strip().lower(), phrase) for label, base, text, phrase in TEXTS]


def _spaced(text: Column) -> Column:
    """Words with one space before, between and after them; a single space if there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _BREAKS, " ")), F.lit(" "))


def word_frequencies(docs: DataFrame) -> dict[str, int]:
    """In how many documents each word of a key phrase stands; all documents count."""
    vocabulary = sorted({w for *_, phrase in TEMPLATES for w in phrase.split()})
    found = F.array_intersect(F.split(F.lower(_spaced(F.col("text"))), " "), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(found).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["n"] for r in rows}


def positional_index(frequencies: dict[str, int], files: int, rare: int = 2) -> list[tuple[int, list[tuple[str, int]]]]:
    """For each template, (word, position) of its ``rare`` words of highest IDF within its key phrase."""
    idf = {w: math.log((files + 1) / (n + 1)) for w, n in frequencies.items()}
    index = []
    for k, (_, _, text, phrase) in enumerate(TEMPLATES):
        words, key = text.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        best = sorted(range(at, at + len(key)), key=lambda i: (-idf[words[i]], words[i], i))[:rare]
        index.append((k, [(words[i], i) for i in best]))
    return index


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, and per file ``found``: array of (label, base, start of the key phrase, score) in order of start."""
    index = positional_index(word_frequencies(docs), docs.count())
    rare = sorted({w for _, posts in index for w, _ in posts})
    texts = docs.select("doc_id", _spaced(F.col("text")).alias("_s"))
    low = F.lower("_s")
    may = texts.select(
        "doc_id",
        F.when(F.col("_s") == "  ", 0).otherwise(F.length("_s") - F.length(F.replace("_s", F.lit(" "))) - 1).cast("long").alias("n_words"),
        # A file without any key phrase's rarest word can hold no template; A-Z only are lower-cased for those that remain.
        F.when(low.rlike(" (" + "|".join(sorted({posts[0][0] for _, posts in index})) + ") "), F.translate("_s", string.ascii_uppercase, string.ascii_lowercase)).alias("_low"),
    )
    words = F.split(F.trim("_low"), " ")
    split = may.withColumn("_words", F.when(F.col("_low").isNotNull(), words))
    looked = split.withColumn(
        "_hits", F.filter(F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda x: x["w"].isin(rare))
    )

    def starts(posts: list[tuple[str, int]]) -> Column:
        """Starts that all postings of a template agree on."""

        def side(word: str, position: int) -> Column:
            return F.transform(F.filter("_hits", lambda x: x["w"] == word), lambda x: x["at"] - position)

        return reduce(F.array_intersect, (side(w, i) for w, i in posts))

    def places(k: int, posts: list[tuple[str, int]]) -> Column:
        """One template's verified places in a file."""
        label, base, text, phrase = TEMPLATES[k]
        whole, key = text.split(), phrase.split()
        at = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
        mandatory, template = F.array(*map(F.lit, key)), F.array(*map(F.lit, whole))

        def stands(s: Column) -> Column:
            return (s + at >= 0) & (F.slice("_words", F.greatest(s + at, F.lit(0)) + 1, len(key)) == mandatory)

        def share(s: Column) -> Column:
            same = F.transform(F.sequence(F.lit(0), F.lit(len(whole) - 1)), lambda i: F.coalesce(F.get("_words", s + i) == F.get(template, i), F.lit(False)))
            return F.size(F.filter(same, lambda x: x)) / F.lit(float(len(whole)))

        return F.transform(
            F.filter(starts(posts), stands),
            lambda s: F.struct(F.lit(label).alias("label"), F.lit(base).alias("base"), (s + at).cast("long").alias("start"), share(s).alias("score")),
        )

    found = [places(k, posts) for k, posts in index]
    each = F.array_sort(F.flatten(F.array(*found)), lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(x["label"] < y["label"], -1).otherwise(1))
    return looked.select("doc_id", "n_words", F.when(F.size("_hits") > 0, each).alias("found"))


def op8_license_positional(spark, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda x: x["base"])
    labels = lambda places: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ","), F.lit(""))
    return scanned.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size(base), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    """The same places and scores from plain comparison of every template at every word."""
    letters = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
    lists = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = []
    for label, base, text, phrase in TEMPLATES:
        whole, key = text.split(), phrase.split()
        at = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
        rows.append(f"('{label}', {base}, {lists(whole)}, {lists(key)}, {at})")
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {letters}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
t(label, base, whole, key, off) AS (VALUES {", ".join(rows)}),
h AS (
  SELECT r, label, base, s, list_sum(list_transform(range(len(whole)), lambda i: (s - off + i >= 0 AND coalesce(ws[greatest(s - off + i, 0) + 1] = whole[i + 1], false))::INT)) / len(whole)::DOUBLE AS score
  FROM (SELECT w.*, t.*, unnest(range(len(ws) - len(key) + 1)) AS s FROM w, t WHERE len(ws) >= len(key) AND list_contains(ws, key[1])) WHERE ws[s + 1 : s + len(key)] = key)
SELECT doc_id, len(ws)::BIGINT AS n_words, count(h.r) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0.0)::DOUBLE AS score
FROM w LEFT JOIN h USING (r) GROUP BY r, doc_id, ws
"""


OP8_SQL = _sql()
