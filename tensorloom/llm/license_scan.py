r"""Licence scans: normalised text against licence templates by Dice over word bigrams.

A text is normalised (lower-cased, everything but a-z and 0-9 one space) and is one run of word bigrams,
whatever its lines, so a licence is found in any layout, alone, in a longer line or inside a long text.
Dice d >= t needs ``t / (2 - t) <= |A| / |B| <= (2 - t) / t``, so a template of s bigrams is compared with
windows of these sizes only. A window starts at a bigram of the template and ends at the last one
within a reach of 1, 1.25 or 1.5 times s (for t = 0.8), as text around a licence only lowers Dice.

Pruning, in this order, none of which loses a window that reaches t:

* words: from each template words are picked, longest first, until fewer bigrams than a window must share
  are left without them. A text without any picked word is out; no bigram of it is made.
* size: a window shares ``t / (2 - t) * s`` bigrams or more with its template, so a start counts only if so many hits
  of the template follow within the longest reach.

Repeats are counted as a multiset: a hit counts unless the window already holds as many of its bigram as the
template has, which its distance to the hit that many places earlier tells.

Windows of one template that overlap, directly or by others, are one place, at its best window; places of different templates that overlap
go to the nearest template.

DataFrame functions only; the templates are a fixed table of a few rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import pick

THRESHOLD = 0.8
#: Reaches of a window, in parts between the template's size and the most that Dice admits.
REACHES = 3

# Published licence notices and texts, by SPDX identifier.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_AGPL_HEADER = _GPL_HEADER.replace("General Public", "Affero General Public")
_LGPL_HEADER = _GPL_HEADER.replace("General Public", "Lesser General Public").replace("This program", "This library")
_GPL2_HEADER = _GPL_HEADER.replace("software:", "software;").replace("version 3", "version 2")
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GPL3_OPENING = f"""GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM} Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."""
_GPL2_OPENING = f"""GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA {_VERBATIM} Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it."""
_AGPL_OPENING = f"""GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM} Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."""
_LGPL_OPENING = f"""GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM} This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."""
_APACHE_OPENING = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."""
_MPL_OPENING = """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_BSL = """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""
#: (licence, kind, body). The long licences (Apache, GPL, MPL) are known by their openings, the others by their whole texts.
TEMPLATES = (
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "This project is licensed under the MIT License."),
    ("MIT", "text", _MIT),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", _APACHE_HEADER),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "opening", _APACHE_OPENING),
    ("GPL-3.0", "header", _GPL_HEADER),
    ("GPL-3.0", "opening", _GPL3_OPENING),
    ("GPL-2.0", "header", _GPL2_HEADER),
    ("GPL-2.0", "opening", _GPL2_OPENING),
    ("LGPL-3.0", "header", _LGPL_HEADER),
    ("LGPL-3.0", "opening", _LGPL_OPENING),
    ("AGPL-3.0", "header", _AGPL_HEADER),
    ("AGPL-3.0", "opening", _AGPL_OPENING),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "notice", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "notice", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "text", f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "text", f"{_BSD_CONDITIONS} {_BSD_THIRD} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "notice", "Released under the BSD 3-Clause License."),
    ("ISC", "text", _ISC),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "opening", _MPL_OPENING),
    ("Zlib", "text", _ZLIB),
    ("BSL-1.0", "opening", _BSL),
    ("Unlicense", "opening", _UNLICENSE),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "notice", "Released under CC0 1.0 Universal."),
)


def words_of(body: str) -> list[str]:
    return re.findall("[a-z0-9]+", body.lower())


def least_common(size: int, threshold: float = THRESHOLD) -> int:
    """Bigrams that a window shares with a template of ``size``, at least, if their Dice reaches the threshold."""
    return max(1, math.ceil(size * threshold / (2 - threshold) - 1e-9))


def reaches(size: int, threshold: float = THRESHOLD) -> list[int]:
    """The windows' greatest lengths for a template of ``size`` bigrams."""
    most = (2 - threshold) / threshold
    return sorted({math.floor(size * (1 + (most - 1) * k / (REACHES - 1)) + 1e-9) for k in range(REACHES)})


def anchors(threshold: float = THRESHOLD, rows=TEMPLATES) -> list[str]:
    """Words of which each window that reaches the threshold with some template holds one."""
    out: set[str] = set()
    held = Counter(w for _, _, body in rows for w in set(words_of(body)))
    for _, _, body in rows:
        words = words_of(body)
        pairs = list(zip(words, words[1:]))
        # Long words are rare in other texts; of short ones those that few templates hold.
        for word in sorted(set(words), key=lambda w: (-len(w), held[w], w)):
            if sum(not out & set(pair) for pair in pairs) < least_common(len(pairs), threshold):
                break
            out.add(word)
    return sorted(out)


def templates(spark: SparkSession, threshold: float = THRESHOLD, rows=TEMPLATES) -> DataFrame:
    """``(t, licence, body, size, least, reach)``: a row for each template."""
    sizes = [len(words_of(body)) - 1 for _, _, body in rows]
    literal = [F.struct(F.lit(t).alias("t"), F.lit(licence).alias("licence"), F.lit(body).alias("body"), F.lit(size).alias("size"), F.lit(least_common(size, threshold)).alias("least"), F.array(*map(F.lit, reaches(size, threshold))).alias("reach")) for t, ((licence, _, body), size) in enumerate(zip(rows, sizes))]
    return spark.range(1).select(F.inline(F.array(*literal)))


def bigrams(words: Column) -> Column:
    """The word bigrams of an array of words, in order; fewer than two words have none."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(pairs, lambda p: p.isNotNull())


def template_grams(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    """``(gram, t, g, times)``: a row for each template and different bigram of it; g is the first place of it there."""
    found = templates(spark, rows=rows).select("t", F.posexplode(bigrams(words(F.col("body")))).alias("pos", "gram"))
    return found.groupBy("t", "gram").agg(F.min("pos").alias("g"), F.count("*").cast("int").alias("times"))


def words(text: Column) -> Column:
    """The normalised words of a text; an array."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _windows(hits: Column, threshold: float) -> Column:
    """The windows of one template, (start, end, dice) each, from its hits (pos, prev) in order."""
    places = F.when(F.size(hits) >= F.col("least"), F.sequence(F.lit(0), F.size(hits) - F.col("least"))).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: F.get(hits, i + F.col("least") - 1)["pos"] - F.get(hits, i)["pos"] < F.element_at("reach", -1))

    def from_(i: Column) -> Column:
        first = F.get(hits, i)["pos"]
        near = F.slice(hits, i + 1, F.element_at("reach", -1))

        def window(reach: Column) -> Column:
            inside = F.filter(near, lambda x: x["pos"] < first + reach)
            # One pass: how many hits count, and where the last one is.
            seen = F.aggregate(
                inside, F.struct(F.lit(0).alias("n"), first.alias("last")),
                lambda acc, x: F.struct((acc["n"] + F.when(x["prev"].isNull() | (x["prev"] < first), 1).otherwise(0)).alias("n"), x["pos"].alias("last")),
            )
            return F.transform(F.array(seen), lambda w: F.struct(first.alias("start"), w["last"].alias("end"), (2.0 * w["n"] / (w["last"] - first + 1 + F.col("size"))).alias("dice")))

        return F.flatten(F.transform("reach", window))

    return F.filter(F.flatten(F.transform(starts, from_)), lambda w: w["dice"] >= threshold)


def _places(windows: DataFrame, *by: str) -> DataFrame:
    """``windows`` with ``place``: those of one key that overlap, directly or by others, have equal numbers."""
    ordered = Window.partitionBy(*by).orderBy("start", "end", "t", "dice")
    top = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = windows.withColumn("opens", F.when(F.col("start") <= top, 0).otherwise(1))
    return opened.withColumn("place", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))


def scan(docs: DataFrame, threshold: float = THRESHOLD, rows=TEMPLATES) -> DataFrame:
    """``(doc_id, licence, n_passages, best_dice)``: the licences that each document holds.

    A place belongs to the licence of its nearest template (ties: the longer template, then the licence that comes first). A row for each
    document and licence; n_passages counts the places, best_dice is the highest Dice.
    Documents without such places, null and empty texts among them, have no
    rows. Rows that repeat a doc_id and its text count as one document; a null
    doc_id stays null. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64(text).alias("h"), words(text).alias("words"))
    base = base.where(F.arrays_overlap("words", F.array(*[F.lit(w) for w in anchors(threshold, rows)])))
    grams = base.select("doc_id", "h", F.posexplode(bigrams(F.col("words"))).alias("pos", "gram"))
    # One row for each template, or template and bigram: the bytes are fixed by TEMPLATES.
    hits = grams.join(F.broadcast(template_grams(docs.sparkSession, rows)), "gram")
    of = ["doc_id", "h", "t"]
    at = hits.groupBy(*of, "g", "times").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    at = at.select(*of, F.transform("at", lambda p, k: F.struct(p.alias("pos"), F.get("at", k - F.col("times")).alias("prev"))).alias("hits"))
    at = at.groupBy(*of).agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    at = at.join(F.broadcast(templates(docs.sparkSession, threshold, rows).drop("body")), "t")
    found = at.where(F.size("hits") >= F.col("least")).select("doc_id", "h", "t", "licence", "size", F.inline(_windows(F.col("hits"), threshold)))
    best = F.max(F.struct("dice", (-F.col("start")).alias("minus"), "end")).alias("best")
    places = _places(found, "doc_id", "h", "t").groupBy("doc_id", "h", "t", "licence", "size", "place").agg(best)
    places = places.select("doc_id", "h", "t", "licence", "size", (-F.col("best.minus")).alias("start"), "best.end", "best.dice")
    nearest = F.min(F.struct((-F.col("dice")).alias("minus"), -F.col("size"), F.col("licence").alias("licence"))).alias("nearest")
    kept = _places(places, "doc_id", "h").groupBy("doc_id", "h", "place").agg(nearest)
    kept = kept.select("doc_id", "h", "nearest.licence", (-F.col("nearest.minus")).alias("dice"))
    return kept.groupBy("doc_id", "h", "licence").agg(F.count("*").alias("n_passages"), F.max("dice").alias("best_dice")).select("doc_id", "licence", "n_passages", "best_dice")
