"""License scans in DataFrame functions only: units of a text against licence templates by Dice coefficient over the
sets of word bigrams. A template of b bigrams can only reach a Dice of t with a unit of t/(2-t)*b to (2-t)/t*b bigrams:
these size bounds prune templates, and a unit that shares no bigram with any template is dropped at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import documents, let, unused

#: Short licences as a whole, below their titles and copyright lines (id, text).
FULL_TEXTS = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
]
#: The notices by which texts refer to a licence, longer ones among them (id, text). Others, whole Apache,
#: GNU or Mozilla licences say, go in by the parameter `templates`.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("all-rights-reserved", "All rights reserved."),
    *FULL_TEXTS,
]


def bigrams(text: Column) -> Column:
    """The set of word bigrams of the normalised text, as 64-bit hashes: lower case, runs of other than letters and digits
    as one blank."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    pairs = lambda w: F.when(F.size(w) > 1, F.array_distinct(F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.xxhash64(x, F.get(w, i + 1))))).otherwise(F.array().cast("array<bigint>"))
    return let(words, pairs)


def _unavoidable(b: list[int], least_share: float) -> list[int]:
    """Some bigrams of a template of which a unit within the size bounds that reaches the coefficient must share one."""
    return sorted(b)[: len(b) - math.ceil(least_share * len(b) - 1e-9) + 1]


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Add license (best match, ties to the smaller name), license_dice and n_license_units (units that match any template).

    Units are the lines of a text, its paragraphs (between blank lines), and the whole text, each distinct unit once.
    A null or empty text, or one of fewer than two words, matches nothing: license and license_dice are null. Very long
    texts are scanned whole; repeated rows are scanned each; columns of the added names are replaced, any others pass; an
    empty table gives an empty result. No row is moved: every document is judged by itself.
    """
    spark = docs.sparkSession
    docs = docs.drop("license", "license_dice", "n_license_units")
    found = unused(docs, "__matches")
    # The templates' own bigrams: as many rows as there are templates.
    rows = spark.createDataFrame(templates, "id string, body string").select("id", bigrams(F.col("body")).alias("b")).collect()
    known = F.array(*(F.struct(F.lit(r.id).alias("id"), F.lit(list(r.b)).alias("b"), F.lit(len(r.b)).alias("n")) for r in rows if r.b))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    # A unit of low * n bigrams or more shares threshold * (low * n + n) / 2 = low * n of the template's n at least.
    some = F.lit(sorted({x for r in rows for x in _unavoidable(r.b, low)}))
    most = int(high * max(len(r.b) for r in rows)) + 1
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    paragraphs = F.when(text.contains("\n"), F.concat(F.split(text, r"\n[\x20\x09\x0B-\x0D]*\n"), F.array(text))).otherwise(F.array().cast("array<string>"))
    units = F.filter(F.array_distinct(F.concat(lines, paragraphs)), lambda u: F.length(u) > 2)
    # A unit of many words repeats bigrams at most as often as it has words: those far beyond `most` are still counted exactly.
    hits = F.filter(F.transform(units, bigrams), lambda b: (F.size(b) > 0) & (F.size(b) <= most) & F.arrays_overlap(b, some))

    def best(b: Column) -> Column:
        near = F.filter(known, lambda t: F.size(b).between(low * t["n"] - 1e-9, high * t["n"] + 1e-9))
        dice = F.transform(near, lambda t: F.struct((-2.0 * F.size(F.array_intersect(b, t["b"])) / (F.size(b) + t["n"])).alias("d"), t["id"].alias("id")))
        return F.array_min(F.filter(dice, lambda s: s["d"] <= -threshold))

    out = docs.withColumn(found, F.filter(F.transform(hits, best), lambda s: s.isNotNull()))
    top = F.array_min(found)
    return out.withColumns({"license": top["id"], "license_dice": F.round(-top["d"], 6), "n_license_units": F.size(found).cast("long")}).drop(found)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every row of documents; cases as in scan_licenses."""
    return scan_licenses(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "license", "license_dice", "n_license_units")


def _sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


OP5_SQL = """
WITH templates(id, body) AS (VALUES %s),
t AS (SELECT id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM (SELECT id, %s AS w FROM templates)),
units AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)),
                 CASE WHEN contains(text, chr(10)) THEN list_append(regexp_split_to_array(text, '\\n[\\x20\\x09\\x0B-\\x0D]*\\n'), text) ELSE [] END)) AS u FROM documents),
words AS (SELECT doc_id, u, %s AS w FROM units WHERE length(u) > 2),
pairs AS (SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) > 1),
hits AS (SELECT doc_id, u, id, 2.0 * len(list_intersect(p.b, t.b)) / (len(p.b) + len(t.b)) AS dice
         FROM pairs p JOIN t ON len(p.b) <= len(t.b) * 1.5 + 1 AND len(p.b) >= len(t.b) / 1.5 - 1),
best AS (SELECT doc_id, count(DISTINCT u) AS n, max(dice) AS d FROM hits WHERE dice >= 0.8 GROUP BY doc_id),
named AS (SELECT b.doc_id, b.n, b.d, min(h.id) AS id FROM best b JOIN hits h ON h.doc_id = b.doc_id AND h.dice = b.d GROUP BY b.doc_id, b.n, b.d)
SELECT doc_id, id AS license, round(d, 6) AS license_dice, coalesce(n, 0) AS n_license_units FROM documents LEFT JOIN named USING (doc_id)
""" % (", ".join("('%s', '%s')" % (i, b.replace("'", "''")) for i, b in TEMPLATES), _sql_words("body"), _sql_words("u"))
