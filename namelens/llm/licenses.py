"""License scans: diagonal voting of word k-grams against templates.

Every text's words give rolling k-gram hashes.  Spark joins all of them to the
positions of the same hashes in the license templates; a match votes for the
diagonal (place in the text less place in the template).  Votes are added per
diagonal, neighbouring diagonals that overlap merge into a span (words that were
put in or left out shift the diagonal), and a span with the votes that a notice
needs at least is verified in its text: windows of twice the template's length go
over the whole span, each the template's length further, and a window that has
COVER of the template's words in order is a notice.  Of overlapping notices the
one with the larger share of its template stays, then the one with more words.  Phrases that name a license are
found beside that.

The join works on distinct texts, so copies vote once; every row gets its
text's result.  Templates are the fixed list below: some nine hundred positions;
a license that is in none of them gives no label.

Defined results: a null text counts as empty and has no words and no labels;
repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namelens.llm.common import LOWER, WORD, checkpoint, mix64, span_hashes, steps, text_buffer, text_of, word_spans

K = 3
#: Words that neighbouring diagonals may be apart, and places that their matches may be.
SHIFT, GAP = 3, 8
#: Share of a template's words that a verified span must have, in order.
COVER = 0.7
#: Spans up to which their table is broadcast (about 100 bytes each).
BROADCAST_SPANS = 100_000

#: Phrases whose places are the base, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Fixed values: (label, wording) of common notices.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "All rights reserved."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("boost", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt"),
)

_TABLE = np.where(WORD[LOWER], LOWER, np.uint8(32)).astype(np.uint8).tobytes()


def words(text: bytes) -> list[bytes]:
    """Runs of digits, a-z and characters beyond ASCII, after lower-casing A-Z."""
    return text.translate(_TABLE).split()


_PHRASES = [(p.encode().split(), label) for p, label in PHRASES]
_TEMPLATE_WORDS = [words(t.encode()) for _, t in TEMPLATES]


def _grams(column: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every k-gram, number of the first gram of every text and their total)."""
    data, offsets = text_buffer(column)
    data = LOWER[data]
    start, end, text = word_spans(data, offsets, WORD)
    h = span_hashes(data, start, end)
    n = np.bincount(text, minlength=len(column))
    grams = np.maximum(0, n - k + 1)
    first = np.r_[0, np.cumsum(grams)]
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    inside = text[: len(text) - k + 1] == text[k - 1 :]
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return mixed[inside], first


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch):
            grams, first = _grams(part.column("text"))
            lists = pa.LargeListArray.from_arrays(pa.array(first), pa.array(grams.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("key"), lists], names=["key", "grams"])


def template_positions(spark) -> DataFrame:
    """gram, template, at: every k-gram of every template."""
    column = pa.array([t for _, t in TEMPLATES])
    grams, first = _grams(column)
    rows = [(int(g), t, at) for t in range(len(TEMPLATES)) for at, g in enumerate(grams[first[t] : first[t + 1]].view(np.int64).tolist())]
    return spark.createDataFrame(rows, "gram long, template int, at int")


def spans(docs: DataFrame) -> DataFrame:
    """key (hash of a text), spans: array of (template, first, last word, votes) that have votes enough to be verified."""
    texts = docs.select(F.xxhash64(text_of()).alias("key"), text_of().alias("text"))
    grams = texts.mapInArrow(_gram_rows, "key long, grams array<long>").select("key", F.posexplode("grams").alias("pos", "gram"))
    matches = grams.join(F.broadcast(template_positions(docs.sparkSession)), "gram").select("key", "template", "at", "pos").distinct()
    diagonals = matches.groupBy("key", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    along = Window.partitionBy("key", "template").orderBy("diagonal", "first")
    apart = (F.col("diagonal") - F.lag("diagonal").over(along) > SHIFT) | (F.col("first") > F.lag("last").over(along) + GAP + K) | (F.col("last") < F.lag("first").over(along) - GAP - K)
    merged = (
        diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("group", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "template", "group").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"))
    )
    # a word that is changed or left out takes K grams at most
    least = F.element_at(F.array(*[F.lit(max(1, math.ceil(len(w) - K + 1 - K * (1 - COVER) * len(w)))) for w in _TEMPLATE_WORDS]), F.col("template") + 1)
    return checkpoint(merged.where(F.col("votes") >= least).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("template", "first", "last", "votes"))).alias("spans")))


def _in_order(template: list[bytes], window: list[bytes]) -> tuple[int, int, int]:
    """(length of the longest common subsequence of words, first word and end of its first place in the window)."""
    if not set(template) & set(window):
        return 0, 0, 0
    m = len(window) + 1
    row = [0] * m  # length * m + place of the first word: of equal lengths the later start is larger
    for x in template:
        diagonal = 0
        for j, y in enumerate(window, 1):
            up = row[j]
            row[j] = max(up, row[j - 1], (diagonal + m if diagonal else m + j - 1) if x == y else 0)
            diagonal = up
    length = row[-1] // m
    end = next(j for j, v in enumerate(row) if v // m == length)
    return length, row[end] % m, end


def notices(found: list[bytes], template: int, first: int, last: int) -> Iterator[tuple[float, int, int, int]]:
    """(share, words, first word, end) of every place between two words that has COVER of the template's words in order."""
    wanted = _TEMPLATE_WORDS[template]
    at = max(0, first - K)
    while at <= last:
        length, start, end = _in_order(wanted, found[at : at + 2 * len(wanted) + 2 * GAP])
        if length >= COVER * len(wanted):
            yield length / len(wanted), length, at + start, at + end
            at += end
        else:
            at += len(wanted)


def scan(text: bytes, candidates: list[dict]) -> tuple:
    """(n_words, n_base, first, last, base labels, labels, score, spans) of a text, given its unverified spans."""
    found = words(text)
    base: list[tuple[int, str]] = []
    if b"license" in text.lower():
        for i, w in enumerate(found):
            if w == b"license":
                for phrase, label in _PHRASES:
                    at = i - len(phrase) + 1
                    if at >= 0 and found[at : i + 1] == phrase:
                        base.append((at, label))
    base_labels = sorted({label for _, label in base})
    places = [(*place, TEMPLATES[c["template"]][0]) for c in candidates for place in notices(found, c["template"], c["first"], c["last"])]
    verified, taken = [], []
    for _, _, start, end, label in sorted(places, key=lambda x: (-x[0], -x[1], x[2:])):
        i = bisect_left(taken, (start, end))
        if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
            taken.insert(i, (start, end))
            verified.append((label, start, end))
    verified.sort(key=lambda x: (x[1], x[2]))
    score = max([1.0 if base else 0.0, *(x[0] for x in places)])
    labels = sorted({*base_labels, *(v[0] for v in verified)})
    starts = [i for i, _ in base]
    return len(found), len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels), score, ",".join(f"{a}:{b}:{c}" for a, b, c in verified)


OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def _scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in OUT.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]] for c in OUT.split(", ")]
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        rows = [scan(t.as_py(), s.as_py() or []) for t, s in zip(texts, batch.column("spans"), strict=True)]
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])


def scans(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of OUT for every row of docs."""
    found = spans(docs)
    rows = docs.select("doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("key"))
    n = found.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(found) if n <= BROADCAST_SPANS else found, "key", "left").select("doc_id", "text", "spans")
    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(_scans, f"doc_id {kind}, {OUT}")
