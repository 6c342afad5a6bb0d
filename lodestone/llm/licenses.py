"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.  DataFrame functions only.

Texts and templates become lower-case words of a-z and 0-9 and hashed five-word shingles.  A template of m shingles is looked for in windows of
L = 2 * 2^ceil(log2 m) shingles that start at every multiple of L / 2, so a copy always lies whole inside a window.  It matches a window
that holds at least 0.8 of its distinct shingles; of its windows the one with the highest containment, then the first, is told.

Retrieval: `BANDS` bands of one MinHash each.  A window's keys meet the table of templates' keys of its length in a hash join; a matching window has a Jaccard
similarity of at least 0.8 / 4.2 to its template, so all bands miss it with a chance below (1 - 0.19)^64 = 1.4e-6.  A pair that several bands find counts in the
first of them.  Exact containment then decides.  The tables of templates have `BANDS` rows a template, so they are broadcast up to `MOST_TEMPLATES` and refused beyond.
Pruning without loss: a template's anchors are words whose shingles are over a fifth of its own, so a window without any of them can't
reach 0.8; only windows around an anchor are hashed.  Texts are never shuffled; hits are, by row and license, to find the best window, and a hot source is only more rows.

Defined cases: null, empty and short texts (under five words) match nothing; repeated rows are told each; a text may match several licenses;
columns beyond doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

SHINGLE, LEAST, BANDS = 5, 0.8, 64
MOST_TEMPLATES = 10_000

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT_HEAD = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GNU_TAIL = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details. You should have received a copy of the {} along with this program."

#: Public license texts, headers and notices by SPDX-like name; README lists them with what they leave out.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC0-1.0-dedication": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + _GNU_TAIL.format("GNU Affero General Public License", "GNU Affero General Public License"),
    "MIT": f"{_MIT_HEAD} {_AS_IS} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-permission": _MIT_HEAD,
    "BSD-2-Clause": f"{_BSD_HEAD} {_BSD_TAIL}",
    "BSD-3-Clause": f"{_BSD_HEAD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_TAIL}",
    "BSD-conditions": _BSD_HEAD,
    "ISC": f"{_ISC_HEAD} {_ISC_TAIL}",
    "ISC-permission": _ISC_HEAD,
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_TAIL}",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense": f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS} IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "PostgreSQL": 'Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.',
}


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def size_class(m: int) -> int:
    """Shingles in a window for a template of m."""
    return 2 << (m - 1).bit_length()


def anchors_of(words: list[str], least: float = LEAST) -> list[str]:
    """The longest words whose shingles are more than 1 - least of a template's."""
    shingles = [tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]
    distinct, picked = set(shingles), []
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        picked.append(w)
        if sum(any(a in s for a in picked) for s in distinct) > (1 - least) * len(distinct) + 1e-9:
            break
    return picked


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingle_array(words: Column) -> Column:
    """Hashes of all five-word shingles, in order."""
    n = F.size(words) - (SHINGLE - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(SHINGLE)), " ")))).otherwise(F.array().cast("array<bigint>"))


def signature(shingles: Column) -> Column:
    """One key a band: the band's number with its smallest hash."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.xxhash64(b, F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b)))))


def prepared(spark, templates: dict[str, str]) -> DataFrame:
    """(license, length, known, bands): templates with the length of their windows, their distinct shingles and their signature."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; {MOST_TEMPLATES} are the bound of what is broadcast")
    short = [k for k, v in templates.items() if len(words_of(v)) < SHINGLE]
    if short:
        raise ValueError(f"templates {short} have under {SHINGLE} words")
    lengths = {k: size_class(len({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})) for k, w in ((k, words_of(v)) for k, v in templates.items())}
    rows = spark.createDataFrame([(k, v, lengths[k]) for k, v in templates.items()], "license string, text string, length int")
    hashed = rows.select("license", "length", F.array_distinct(shingle_array(word_array(F.col("text")))).alias("known"))
    return hashed.withColumn("bands", signature(F.col("known")))


def windows(words: Column, shingles: Column, anchors: list[str], length: int) -> Column:
    """Windows (length, start, shingles) that hold a shingle with an anchor."""
    stride = length // 2
    near = F.filter(F.transform(words, lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())
    low = lambda p: F.greatest(F.lit(0), F.floor((p - (SHINGLE - 1) - length) / stride).cast("int") + 1)
    last = F.floor((F.size(shingles) - 1) / stride).cast("int")
    high = lambda p: F.least(F.floor(p / stride).cast("int"), last)
    numbers = F.array_distinct(F.flatten(F.transform(near, lambda p: F.when(low(p) <= high(p), F.sequence(low(p), F.greatest(low(p), high(p)))).otherwise(F.array().cast("array<int>")))))
    return F.transform(numbers, lambda k: F.struct(F.lit(length).alias("length"), (k * stride).cast("bigint").alias("start"), F.slice(shingles, k * stride + 1, F.lit(length)).alias("shingles")))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, n_shared, containment, window_start) for every row and license that match; window_start counts words."""
    templates = templates or TEMPLATES
    known = prepared(docs.sparkSession, templates)
    of_length: dict[int, set[str]] = defaultdict(set)
    for text in templates.values():
        w = words_of(text)
        of_length[size_class(len({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}))].update(anchors_of(w))
    anchors = sorted(set().union(*of_length.values()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_array(F.col("text")).alias("words"))
    rows = rows.filter(F.exists("words", lambda w: w.isin(anchors))).select(F.monotonically_increasing_id().alias("row"), "doc_id", "words", shingle_array(F.col("words")).alias("shingles"))
    all_windows = F.concat(*(windows(F.col("words"), F.col("shingles"), sorted(own), length) for length, own in sorted(of_length.items())))
    found = rows.select("row", "doc_id", F.explode(all_windows).alias("w")).select("row", "doc_id", "w.*").withColumn("own", signature(F.col("shingles")))
    keys = known.groupBy("length").agg(F.array_distinct(F.flatten(F.collect_list("bands"))).alias("keys"))  # BANDS rows a template
    met = found.join(F.broadcast(keys), "length").withColumn("shared", F.array_intersect("own", "keys")).filter(F.size("shared") > 0).drop("keys")
    banded = known.select("license", "length", "known", "bands", F.explode("bands").alias("key"))
    pairs = met.withColumn("key", F.explode("shared")).join(F.broadcast(banded), ["length", "key"]).filter(F.col("key") == F.array_min(F.array_intersect("own", "bands")))
    held = pairs.select("row", "doc_id", "license", "start", F.size(F.array_intersect("known", "shingles")).cast("bigint").alias("n"), F.size("known").alias("m")).filter(F.col("n") / F.col("m") >= LEAST)
    best = held.groupBy("row", "license").agg(F.max(F.struct("n", (-F.col("start")).alias("back"), "doc_id", "m")).alias("x"))
    return best.select("x.doc_id", "license", F.col("x.n").alias("n_shared"), (F.col("x.n") / F.col("x.m")).alias("containment"), (-F.col("x.back")).alias("window_start"))


def op9(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle(templates: dict[str, str] | None = None) -> str:
    """The same without MinHash: every window against every template."""
    values = []
    for name, text in (templates or TEMPLATES).items():
        words = words_of(text)
        shingles = dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1))
        values += [f"('{name}', '{s}', {len(shingles)}, {size_class(len(shingles))})" for s in shingles]
    return f"""
WITH t(license, shingle, m, len) AS (VALUES {", ".join(values)}
), d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, i - 1 AS pos, array_to_string(list_slice(ws, i, i + 4), ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM d WHERE len(ws) >= 5)
), hit AS (SELECT doc_id, pos, license, shingle, m, len // 2 AS stride FROM s JOIN t USING (shingle)
), placed AS (
  SELECT doc_id, license, m, stride, pos // stride AS k, shingle FROM hit
  UNION ALL SELECT doc_id, license, m, stride, pos // stride - 1, shingle FROM hit WHERE pos >= stride
), counted AS (SELECT doc_id, license, m, k * stride AS start, count(DISTINCT shingle) AS n FROM placed GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY n DESC, start) AS r FROM counted WHERE CAST(n AS DOUBLE) / m >= 0.8)
SELECT doc_id, license, CAST(n AS BIGINT) AS n_shared, CAST(n AS DOUBLE) / m AS containment, CAST(start AS BIGINT) AS window_start FROM ranked WHERE r = 1
"""


ORACLE = oracle()
