"""Licence scans: TF-IDF cosine of lines to templates, and inheritance down directories.

Parts of a file (lines, or also paragraphs and the whole) are compared with templates (notices, or
also licence texts); words weigh by their inverse frequency among the templates, unknown
words the most.  A file whose best part reaches the threshold declares that licence.  A file without one inherits from the licence file of the
nearest ancestor directory.

A line can only reach the threshold if it has one of the *key words*: those are added per
template, rarest first, until the rest of the template, on its own, stays below the threshold
(Cauchy-Schwarz).  So texts and lines without any key word are passed over exactly, and so
are lines with too many words that no template has; only the others are taken apart.

Everything is DataFrame expressions.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, lower_ascii

#: Licence identifiers and the notices by which files declare them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "Licensed under the GNU General Public License v3"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "MIT License"),
)

#: Texts of licences and the notices of several lines by which files refer to them.
TEXTS = (
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written
permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details. You should have received a copy of the GNU General Public License along with this program.
If not, see https://www.gnu.org/licenses/."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The
above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""),
)
THRESHOLD = 0.8
_TERM = "[a-z0-9]+"
#: Words that tell versions apart: a part without all of a template's is not under that licence, however alike.
VERSION = "v?[0-9]+"


def terms(text: str) -> list[str]:
    return re.findall(_TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def weigh(templates=TEMPLATES, threshold: float = THRESHOLD) -> tuple[list[tuple[int, str, str, float]], float, list[str]]:
    """Unit vectors of the templates as rows, the weight of an unknown word, and the key words.

    idf is ln((1 + n) / (1 + df)) + 1.  A template is told from others by its number.  Which words are keys
    decides how many parts are looked at, not what is found.
    """
    bags = [Counter(terms(text)) for _, text in templates]
    df = Counter(t for bag in bags for t in bag)
    n = len(bags)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    rows, keys = [], set()
    for i, bag in enumerate(bags):
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in bag.items()))
        rows += [(i, templates[i][0], t, k * idf[t] / norm) for t, k in bag.items()]
    for i in range(n):
        # long words are rarer in prose: short ones and numbers come last
        own = sorted(((len(t), round(w, 9), t, w) for j, _, t, w in rows if j == i and t not in keys), reverse=True)
        left = sum(w * w for *_, w in own)
        for *_, t, w in own:
            if left < (threshold * 0.999) ** 2:
                break
            keys.add(t)
            left -= w * w
    return rows, math.log(1 + n) + 1, sorted(keys)


def lines(text: Column) -> Column:
    """Each line of a text."""
    return F.split(text, "[\n\r]")


def blocks(text: Column) -> Column:
    """The whole text, each of its paragraphs, each of its lines.

    So a licence file, a header wrapped over several lines and a notice on one line are each compared as
    one.
    """
    even = F.regexp_replace(text, "\r\n?", "\n")
    return F.concat(F.array(even), F.split(even, "\n[ \t]*\n"), F.split(even, "\n"))


def scan(files: DataFrame, id_col: str, text_col: str, templates=TEMPLATES, threshold: float = THRESHOLD, units: Callable[[Column], Column] = lines) -> DataFrame:
    """``id, license, score, line``: the best declared licence of each file that has one.

    ``units`` makes an array of the parts of a text that are compared; ``line`` is the place (from 0) of the
    first part of the best score; ties go to the earlier part, then the smaller licence.  A template whose numbers a
    part does not all have is no match.  A bag of words is scored once, in however many parts it stands.  Rows that share an
    id are one file's parts, so repeated rows declare what one of them does.  Null texts and parts
    without words declare nothing; texts of any length are read whole; an empty table
    declares nothing.
    """
    spark = files.sparkSession
    rows, unknown, keys = weigh(templates, threshold)
    idf: dict[str, float] = {}
    n = len(templates)
    df = Counter(t for _, text in templates for t in set(terms(text)))
    for t, k in df.items():
        idf[t] = math.log((1 + n) / (1 + k)) + 1
    weights = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    versions = Counter(i for i, _, t, _ in rows if re.fullmatch(VERSION, t))
    numbered = [(*r, bool(re.fullmatch(VERSION, r[2])), versions[r[0]]) for r in rows]
    vectors = F.broadcast(spark.createDataFrame(numbered, "template int, license string, term string, w double, version boolean, versions long"))

    text, any_key = F.col(f"`{text_col}`"), "(?i)(?<![a-z0-9])(?:" + "|".join(keys) + ")(?![a-z0-9])"
    told = files.where(text.rlike(any_key)).select(F.col(f"`{id_col}`").alias("id"), F.posexplode(units(text)).alias("line", "words"))
    bag = F.regexp_extract_all(lower_ascii(F.col("words")), F.lit(_TERM), F.lit(0))
    # in an array of one, a bag is made once, whatever reads it
    bags = F.filter(F.array(bag), lambda b: F.arrays_overlap(b, F.array(*[F.lit(k) for k in keys])) & _may_reach(b, idf, unknown, threshold))
    met = told.where(F.col("words").rlike(any_key)).select("id", "line", F.explode_outer(bags).alias("bag")).where("bag is not null")
    met = cut(met, "parts")
    distinct = cut(met.select("bag").distinct().withColumn("at", F.monotonically_increasing_id()), "bags")
    tf = distinct.select("at", F.explode("bag").alias("term")).groupBy("at", "term").agg(F.count("*").alias("tf"))
    weighed = tf.join(weights, "term", "left").withColumn("w1", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    norms = weighed.groupBy("at").agg(F.sqrt(F.sum(F.col("w1") * F.col("w1"))).alias("norm"))
    dots = weighed.join(vectors, "term").groupBy("at", "template", "license", "versions").agg(F.sum(F.col("w1") * F.col("w")).alias("dot"), F.count_if("version").alias("has"))
    scored = dots.where("has = versions").join(norms, "at").select("at", "license", F.least(F.col("dot") / F.col("norm"), F.lit(1.0)).alias("score"))
    # equal up to rounding is a tie
    of_bag = F.min_by(F.struct("license", "score"), F.struct(-F.round("score", 9), "license"))
    found = scored.where(F.col("score") >= threshold - 1e-12).groupBy("at").agg(of_bag.alias("b"))
    found = cut(found.join(distinct, "at").select("bag", "b.license", "b.score"), "found")
    best = F.min_by(F.struct("license", "score", "line"), F.struct(-F.round("score", 9), "line", "license"))
    return met.join(found, "bag").groupBy("id").agg(best.alias("b")).select("id", "b.license", "b.score", "b.line")


def _may_reach(bag: Column, idf: dict[str, float], unknown: float, threshold: float) -> Column:
    """Whether a line's cosine with any template can reach the threshold.

    With K the square of its known words' vector and U that of the others, no cosine squared
    exceeds K / (K + U), and U is at least the square of the number of other words over that of distinct ones,
    times ``unknown`` squared.
    """
    weight = F.create_map(*[F.lit(x) for pair in sorted(idf.items()) for x in pair])
    least = (threshold * 0.999) ** 2

    def enough(known: Column) -> Column:
        square = lambda t: F.pow(F.size(F.filter(known, lambda x: x == t)) * weight[t], F.lit(2.0))
        k = F.aggregate(F.array_distinct(known), F.lit(0.0), lambda total, t: total + square(t))
        others, distinct = F.size(bag) - F.size(known), F.size(F.array_distinct(bag)) - F.size(F.array_distinct(known))
        return k * (1 - least) >= F.coalesce(F.try_divide(others * others.cast("double"), distinct), F.lit(0.0)) * (least * unknown * unknown)

    known = F.filter(bag, lambda x: F.array_contains(F.array(*[F.lit(t) for t in sorted(idf)]), x))
    return F.exists(F.array(known), enough)


def ancestors(directory: Column) -> Column:
    """The directory itself and those above, up to the empty one: structs (dir, depth)."""
    parts = F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir"), i.alias("depth")))


def inherit(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Add to ``files(id, path, licence_file)`` the licence of each, own or inherited.

    A file's own licence wins; else that of the licence file (the smallest path, if a
    directory has several) in the nearest directory at or above its own.  Returns ``id, path,
    license, score, origin, license_dir``; origin is header, inherited or none.
    """
    directory = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    own = cut(files.join(declared, "id", "left").withColumn("dir", directory), "files")
    given = own.where("licence_file and license is not null").groupBy("dir").agg(F.min_by(F.struct("license", "score"), F.struct("path", "license", "score")).alias("given"))
    dirs = own.select("dir").distinct().select(F.col("dir").alias("below"), F.explode(ancestors(F.col("dir"))).alias("a")).select("below", "a.dir", "a.depth")
    nearest = dirs.join(given, "dir").groupBy("below").agg(F.max_by(F.struct("dir", "given"), "depth").alias("x"))
    nearest = nearest.select(F.col("below").alias("dir"), F.col("x.dir").alias("from"), F.col("x.given.license").alias("l2"), F.col("x.given.score").alias("s2"))
    both = own.join(nearest, "dir", "left")
    has = F.col("license").isNotNull()
    origin = F.when(has, "header").when(F.col("l2").isNotNull(), "inherited").otherwise("none")
    return both.select(
        "id", "path", F.coalesce("license", "l2").alias("license"), F.when(has, F.col("score")).otherwise(F.col("s2")).alias("score"), origin.alias("origin"), F.when(~has, F.col("from")).alias("license_dir")
    )


def license_scan(files: DataFrame, path: Column, licence_file: Column | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Scan whole texts and inherit along ``path``.

    ``licence_file`` says which rows speak for their directory; it may use the column
    ``line`` of the best declaring line.  By default those are the files named LICENSE,
    LICENCE, COPYING or NOTICE.  Null paths are empty names in the root directory; rows with a
    null id or text declare nothing but inherit.  Rows that share an id share what is
    declared.  Other columns play no part.
    """
    named = F.upper(F.regexp_extract("path", "([^/.]*)[^/]*$", 1)).isin("LICENSE", "LICENCE", "COPYING", "NOTICE")
    speaks = named if licence_file is None else licence_file
    declared = scan(files, id_col, text_col, **how)
    rows = files.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(path, F.lit("")).alias("path"))
    known = cut(declared, "declared")
    rows = rows.join(known.select("id", "line"), "id", "left").withColumn("licence_file", F.coalesce(speaks, F.lit(False))).drop("line")
    return inherit(rows, known.select("id", "license", "score"))


