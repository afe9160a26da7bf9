"""License scans in DataFrame operations alone: Dice coefficient over word bigrams, with size bounds.

Units of a document are its lines and, where it has several lines, the whole text. A unit and a template are compared by their
words (runs of a-z and 0-9 after lower-casing) as bags of word bigrams: Dice = 2 * common / (size + size). A template is
a candidate for a unit only if the sizes alone allow ``min_percent``; a unit with no candidate is dropped before its
bigrams are made. Bigrams meet the templates' by a broadcast of the templates, which are a fixed list. What is left are
the few bigrams that a unit shares with a template of like size; they are counted by document, and only counts are
shuffled. No text is shuffled.

Passages: a licence that no line and no whole text of a document matches is looked for in all runs of the text's words, over
line ends and inside longer lines. A run is as good as its Dice, and the best run of a licence is one more unit. A match
shares at least size * p / (200 - p) bigrams with its template (p: ``min_percent``), so documents with fewer of a template's
bigrams are left out before any bigram is exploded; no text with a match is. A run that matches can be cut to begin and
end with a template's bigram without losing Dice, so these runs alone are counted.

Defined cases: a null or empty text has no units with words, so no match; units of fewer than two words match nothing; of equal Dice
the smaller licence name is best; repeated rows have equal results and are counted apart from one another; a null
doc_id stays null; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.common import bounded, stored, text_of

MIN_PERCENT = 80
#: Notices, and what whole licence files say after the copyright line, by licence. The licences' own words.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_REST = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_TWO = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
APACHE_GRANT = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
APACHE_REST = "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
MPL_GRANT = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
MPL_REST = "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
UNLICENSE_GRANT = "This is free and unencumbered software released into the public domain."
UNLICENSE_REST = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE_GRANT),
    ("Apache-2.0", f"{APACHE_GRANT} {APACHE_REST}"),
    ("BSD", BSD_GRANT),
    ("BSD", f"{BSD_GRANT} {BSD_TWO} {BSD_REST}"),
    ("BSD", f"{BSD_GRANT} {BSD_TWO} {BSD_THREE} {BSD_REST}"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", ISC_GRANT),
    ("ISC", f"{ISC_GRANT} {ISC_REST}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", MIT_GRANT),
    ("MIT", f"{MIT_GRANT} {MIT_REST}"),
    ("MPL-2.0", MPL_GRANT),
    ("MPL-2.0", f"{MPL_GRANT} {MPL_REST}"),
    ("Reserved", "All rights reserved."),
    ("Unlicense", UNLICENSE_GRANT),
    ("Unlicense", f"{UNLICENSE_GRANT} {UNLICENSE_REST}"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)


def words_of(text: str) -> list[str]:
    """A template's words, as the unit's are made in the plan."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def template_rows(templates=TEMPLATES) -> list[tuple]:
    """(template, licence, size, first word, second word, times) of each template's distinct bigrams."""
    out = []
    for i, (name, text) in enumerate(templates):
        words = words_of(text)
        for (a, b), n in Counter(zip(words, words[1:])).items():
            out.append((i, name, len(words) - 1, a, b, n))
    return out


def size_fits(size: Column, other: Column | int, min_percent: int) -> Column:
    """Whether a Dice of min_percent is possible with the smaller of two sizes all common."""
    other = F.lit(other) if isinstance(other, int) else other
    return 200 * F.least(size, other) >= min_percent * (size + other)


def matches(docs: DataFrame, templates=TEMPLATES, min_percent: int = MIN_PERCENT) -> DataFrame:
    """k1, k2 (the row's key), unit, licence, common, total (of sizes): every template match of every unit."""
    spark = docs.sparkSession
    known = spark.createDataFrame(template_rows(templates), "template int, licence string, size int, w1 string, w2 string, times int")
    sizes = sorted({len(words_of(t)) - 1 for _, t in templates})
    text = text_of(F.col("text"))
    key = [F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), text, F.col("doc_id")).alias("k2")]
    lines = F.split(text, "\n")
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array(text))).otherwise(lines)
    # Words are made below the generator, so that no filter above it makes them again; empty strings at the ends are none.
    worded = F.transform(units, lambda u: F.array_remove(F.split(F.lower(u), "[^a-z0-9]+"), ""))
    words = docs.select(*key, F.posexplode(worded).alias("unit", "w"))
    size = F.size("w") - 1
    fits = F.lit(False)
    for s in sizes:
        fits = fits | size_fits(size, s, min_percent)
    pairs = words.where((size > 0) & fits).select(
        "k1", "k2", "unit", size.alias("n"), F.posexplode(F.arrays_zip(F.slice("w", 1, size).alias("a"), F.slice("w", 2, size).alias("b"))).alias("at", "p")
    )
    met = pairs.join(F.broadcast(known), (F.col("p.a") == F.col("w1")) & (F.col("p.b") == F.col("w2")) & size_fits(F.col("n"), F.col("size"), min_percent))
    # Equal rows have equal positions, so distinct positions count each row's bigrams once.
    found = met.groupBy("k1", "k2", "unit", "template", "licence", "n", "size", "w1", "w2", "times").agg(F.count_distinct("at").alias("seen"))
    common = F.sum(F.least("seen", "times")).alias("common")
    scored = found.groupBy("k1", "k2", "unit", "template", "licence", "n", "size").agg(common).withColumn("total", F.col("n") + F.col("size"))
    return scored.where(200 * F.col("common") >= min_percent * F.col("total")).select("k1", "k2", "unit", "licence", "common", "total")


def passages(docs: DataFrame, found: DataFrame, templates=TEMPLATES, min_percent: int = MIN_PERCENT) -> DataFrame:
    """As matches(): the best run of words of every licence that the document (k1, k2) does not have in found; units are negative."""
    spark = docs.sparkSession
    known = spark.createDataFrame(template_rows(templates), "template int, licence string, size int, w1 string, w2 string, times int")
    text = text_of(F.col("text"))
    key = [F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), text, F.col("doc_id")).alias("k2")]
    least = []
    for i in range(len(templates)):
        own = [r for r in template_rows(templates) if r[0] == i]
        if own:
            size = own[0][2]
            needed = -(-size * min_percent // (200 - min_percent)) - (size - len(own))  # of its distinct bigrams
            hashes = F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for _, _, _, a, b, _ in own])
            least.append(F.struct(F.lit(i).alias("template"), F.lit(needed).alias("needed"), hashes.alias("hashes")))
    every = F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in sorted({r[3:5] for r in template_rows(templates)})])

    def bigrams(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))

    def possible(w: Column) -> Column:
        # Within a lambda, so that the intersection is made once and not once a template.
        each = F.transform(
            F.array(F.array_intersect(bigrams(w), every)),
            lambda p: F.filter(F.array(*least), lambda t: F.size(F.array_intersect(p, t["hashes"])) >= t["needed"]),
        )
        return F.transform(each[0], lambda t: t["template"])

    worded = F.transform(F.array(text), lambda t: F.array_remove(F.split(F.lower(t), "[^a-z0-9]+"), ""))
    rows = docs.select(*key, F.explode(F.transform(worded, lambda w: F.struct(w.alias("w"), possible(w).alias("may")))).alias("x"))
    rows = rows.where((F.size("x.may") > 0) & (F.size("x.w") > 1))
    size = F.size("x.w") - 1
    both = F.arrays_zip(F.slice("x.w", 1, size).alias("a"), F.slice("x.w", 2, size).alias("b"))
    pairs = rows.select("k1", "k2", F.col("x.may").alias("may"), F.posexplode(both).alias("at", "p"))
    met = pairs.join(F.broadcast(known), (F.col("p.a") == F.col("w1")) & (F.col("p.b") == F.col("w2")) & F.array_contains("may", F.col("template")))
    own = ["k1", "k2", "template", "licence", "size"]
    # Equal rows have equal positions.
    bag = met.select(*own, "at", "times", F.xxhash64("w1", "w2").alias("gram")).dropDuplicates(["k1", "k2", "template", "at"])
    bag = bag.join(found.select("k1", "k2", "licence").distinct(), ["k1", "k2", "licence"], "left_anti")
    # A run is at most longest bigrams long and begins where that many bigrams have enough of the template's; it ends in its
    # first block of that length or in the next.
    of, longest = Window.partitionBy("k1", "k2", "template").orderBy("at"), int((200 - min_percent) * max(r[2] for r in template_rows(templates)) / min_percent)
    fits = F.col("at") - F.col("start") < F.floor((200 - min_percent) * F.col("size") / min_percent)
    ahead = F.count(F.lit(1)).over(of.rangeBetween(0, longest - 1))
    block = F.floor(F.col("at") / longest)
    bag = stored(bag.withColumn("ahead", ahead).withColumn("block", block), "passages")
    starts = bag.where((200 - min_percent) * F.col("ahead") >= min_percent * F.col("size")).select(
        "k1", "k2", "template", F.col("at").alias("start"), F.explode(F.array("block", F.col("block") + 1)).alias("block")
    )
    run = ["k1", "k2", "template", "start"]
    wide = starts.join(bag, ["k1", "k2", "template", "block"]).where((F.col("at") >= F.col("start")) & fits)
    nth = F.row_number().over(Window.partitionBy(*run, "gram").orderBy("at"))
    counted = wide.withColumn("shared", (nth <= F.col("times")).cast("long"))
    counted = counted.withColumn("common", F.sum("shared").over(Window.partitionBy(*run).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    total = (F.col("at") - F.col("start") + 1 + F.col("size")).alias("total")
    good = counted.select("k1", "k2", "licence", "common", total).where(200 * F.col("common") >= min_percent * F.col("total"))
    order = F.struct((-2 * F.col("common") / F.col("total")).alias("d"), "common", "total")
    best = good.groupBy("k1", "k2", "licence").agg(F.min(order).alias("best"))
    names = sorted({name for name, _ in templates})
    unit = F.lit(0) - F.array_position(F.array(*[F.lit(x) for x in names]), F.col("licence"))
    return best.select("k1", "k2", unit.cast("int").alias("unit"), "licence", "best.common", "best.total")


def report(docs: DataFrame, templates=TEMPLATES, min_percent: int = MIN_PERCENT, runs: bool = False) -> DataFrame:
    """doc_id, n_units (matched units), licences (sorted, comma-joined), best_licence, best_dice of every document. runs: passages count too."""
    found = matches(docs, templates, min_percent)
    if runs:
        found = stored(found, "units")
        found = found.unionByName(passages(docs, found, templates, min_percent))
    hits = stored(found.withColumn("dice", F.round(2 * F.col("common") / F.col("total"), 6)), "licences")
    each = hits.groupBy("k1", "k2").agg(
        F.count_distinct("unit").alias("n_units"),
        F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("licences"),
        F.min(F.struct((-F.col("dice")).alias("d"), "licence")).alias("best"),
    )
    text = text_of(F.col("text"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), text, F.col("doc_id")).alias("k2"))
    joined = rows.join(bounded(stored(each, "best"), ("licences",)), ["k1", "k2"], "left")
    return joined.select(
        "doc_id", F.coalesce("n_units", F.lit(0).cast("long")).alias("n_units"), F.coalesce("licences", F.lit("")).alias("licences"),
        F.coalesce("best.licence", F.lit("")).alias("best_licence"), F.coalesce(-F.col("best.d"), F.lit(0.0)).alias("best_dice"),
    )
