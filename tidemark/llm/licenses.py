"""License scans: TF-IDF cosine to templates, then inheritance along directories.

Every document is compared piece by piece with the templates: its lines, its paragraphs (runs of lines
with words, for notices that are wrapped) and its whole text, as sparse TF-IDF vectors, whose document
frequencies are counted over all documents. Templates are notices, headings and whole short licences.
The best match at or above ``least`` is the document's own licence; a reservation of all rights counts
only where no licence is found. A piece that negates what its template does not, or that opens with a
quotation mark, is no notice. A text is a licence file if its first line, its first paragraph or the
whole of it matches, so that long licences are known by their headings.

Only pieces with a telling term are compared: of every template the rarest terms, as many as it takes for
no cosine to reach ``least`` without any of them (by Cauchy-Schwarz; nothing is lost).

The frequencies of all terms are one grouped aggregation; those of the templates' terms come to the driver.
A piece with further words could only match if it does so with them as light as words of every document;
to those pieces, few, the words' own frequencies are joined before they are scored.

A directory takes the licence that most of its licence files have. A document without a licence of
its own inherits from the nearest directory above it that has one. Directories, of which there are
far fewer than documents, are joined to their ancestors by path; documents are joined to the result
for their own directory only. Counts per directory are combined before the shuffle, and a
directory that holds a third of all documents is a skewed join that Spark splits.

Defined results for odd input: a null or empty text has no licence of its own; equal scores go to
the template whose name comes first, and a directory's ties likewise; null path parts read ``_``;
repeated rows are documents of their own; texts of any length are read whole; an empty table gives
an empty result; further input columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import map_arrow, materialize

LEAST = 0.7
#: Different terms that a match has in common with its template (or all, if it has fewer): a stray word is no notice.
LEAST_TERMS = 3
#: Places of a cosine that count.
DIGITS = 9
LAST_RESORT = "Proprietary"
#: Terms that a task counts before it hands them on.
TERMS_HELD = 1 << 18
SHELF = 1000

# Public texts, headings and notices of common licences.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    "permission notice appear in all copies."
)
_ISC_REST = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_BSD_THREE = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission."
)
_BSD_REST = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
    "under the License."
)
_FREE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, "
    "either version {} of the License, or (at your option) any later version."
)
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _FREE.format("Affero General Public", "3")),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", _BSD + _BSD_TWO + _BSD_REST),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", _BSD),
    ("BSD-3-Clause", _BSD + _BSD_TWO + _BSD_THREE + _BSD_REST),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _FREE.format("General Public", "2")),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _FREE.format("General Public", "3")),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "ISC License"),
    ("ISC", _ISC),
    ("ISC", _ISC + _ISC_REST),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _FREE.format("Lesser General Public", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_REST),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (LAST_RESORT, "All rights reserved."),
    (LAST_RESORT, "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
NEGATIONS = ("aren", "cannot", "didn", "doesn", "isn", "neither", "never", "no", "nor", "not", "wasn")
QUOTES = "\"'>\u00ab\u2018\u201a\u201c\u201e"

_TERM = re.compile(r"[^\W_]+")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


@dataclass(frozen=True)
class Piece:
    """``kind``: 0 a line, 1 a paragraph, 2 the whole text; ``line``: its first (from 0; -1: the whole text)."""

    kind: int
    line: int
    terms: Counter
    top: bool


@dataclass(frozen=True)
class Found:
    name: str
    score: float
    line: int
    is_file: bool


class Matcher:
    """Sparse cosine to all templates at once, through an inverted index of their terms."""

    def __init__(self, templates: tuple[tuple[str, str], ...], frequency: dict[str, int], documents: int, least: float):
        self.least, self.names, self.documents = least, [name for name, _ in templates], documents
        self.idf = {t: math.log((1 + documents) / (1 + n)) + 1 for t, n in frequency.items()}
        self.unseen = math.log(1 + documents) + 1
        self.index: dict[str, list[tuple[int, float]]] = {}
        self.telling: set[str] = set()
        self.shared, self.negated = [], []
        for k, (_, text) in enumerate(templates):
            weight = {t: n * self.idf.get(t, self.unseen) for t, n in Counter(terms(text)).items()}
            norm = math.sqrt(sum(w * w for w in weight.values()))
            left = 1.0
            for t, w in sorted(weight.items(), key=lambda x: (-self.idf.get(x[0], self.unseen), x[0])):
                self.index.setdefault(t, []).append((k, w / norm))
                if left >= least * least - 1e-6:  # the commoner terms could still reach a match without this one
                    self.telling.add(t)
                left -= (w / norm) ** 2
            self.shared.append(min(LEAST_TERMS, len(weight)))
            self.negated.append({t for t in NEGATIONS if t in weight})

    def weight(self, n: int) -> float:
        """Of a term that ``n`` documents hold."""
        return math.log((1 + self.documents) / (1 + n)) + 1

    def pieces(self, text: str) -> list[Piece]:
        """Those that hold a telling term and do not open with a quotation mark."""
        if self.telling.isdisjoint(terms(text)):
            return []
        lines = [(k, line, found) for k, line in enumerate(text.split("\n")) if (found := terms(line))]
        found = [Piece(0, k, Counter(ts), n == 0) for n, (k, line, ts) in enumerate(lines) if self._may(line, ts)]
        at = 0
        for n in range(1, len(lines) + 1):
            if n == len(lines) or lines[n][0] != lines[n - 1][0] + 1:
                ts = [t for _, _, x in lines[at:n] for t in x]
                if n - at > 1 and self._may(lines[at][1], ts):
                    found.append(Piece(1, lines[at][0], Counter(ts), at == 0))
                at = n
        ts = [t for _, _, x in lines for t in x]
        if len(lines) > 1 and self._may(text, ts):
            found.append(Piece(2, -1, Counter(ts), True))
        return found

    def _may(self, text: str, found: list[str]) -> bool:
        return not self.telling.isdisjoint(found) and text.lstrip()[:1] not in QUOTES

    def best(self, found: Counter, others: dict[str, float] | None = None, unseen: float | None = None) -> tuple[bool, float, str] | None:
        """The best match of at least ``least``: whether it is the last resort, minus its cosine, and its licence.

        Terms outside the templates weigh what ``others`` says, else ``unseen``, else as much as the rarest.
        """
        others, unseen = others or {}, self.unseen if unseen is None else unseen
        dot: dict[int, float] = {}
        shared: Counter = Counter()
        square = 0.0
        for t, n in found.items():
            w = n * (self.idf[t] if t in self.idf else others.get(t, unseen))
            square += w * w
            for k, v in self.index.get(t, ()):
                dot[k] = dot.get(k, 0.0) + w * v
                shared[k] += 1
        negations = {t for t in NEGATIONS if t in found}
        close = []
        for k, d in dot.items():
            score = round(d / math.sqrt(square), DIGITS)
            if score >= self.least and shared[k] >= self.shared[k] and negations <= self.negated[k]:
                close.append((self.names[k] == LAST_RESORT, -score, self.names[k]))
        return min(close, default=None)

    def open_terms(self, pieces: list[Piece]) -> list[str] | None:
        """The terms outside the templates on whose frequencies a match depends: of the pieces that match where such terms weigh least. None: no piece does."""
        near = [p for p in pieces if self.best(p.terms, unseen=1.0)]
        return sorted({t for p in near for t in p.terms} - self.idf.keys()) if near else None

    def decide(self, pieces: list[Piece], others: dict[str, float] | None = None) -> Found | None:
        """The text's own licence, and whether it is a licence file."""
        got = [(self.best(p.terms, others), p) for p in pieces]
        ranked = sorted((*match, p.kind, p.line) for match, p in got if match)
        if not ranked:
            return None
        _, score, name, _, line = ranked[0]
        return Found(name, min(-score, 1.0), line, any(match and p.top for match, p in got))


def _count(batches) -> Iterator[pa.RecordBatch]:
    """How many documents hold each term, in parts that fit in memory; the null term counts all."""
    n: Counter = Counter()

    def part() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            n.update({None, *terms(text or "")})
            if len(n) > TERMS_HELD:
                yield part()
                n.clear()
    yield part()


FOUND = "doc_id long, directory string, path string, own_license string, score double, line int, is_license_file boolean"


def _rows(batch: pa.RecordBatch, found: list[Found | None], *more: tuple[str, pa.Array]) -> pa.RecordBatch:
    columns = [
        pa.array([f and f.name for f in found], pa.string()),
        pa.array([f and f.score for f in found], pa.float64()),
        pa.array([f and f.line for f in found], pa.int32()),
        pa.array([bool(f and f.is_file) for f in found], pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("directory"), batch.column("path"), *columns, *(c for _, c in more)],
        names=["doc_id", "directory", "path", "own_license", "score", "line", "is_license_file", *(n for n, _ in more)],
    )


def _scan(batches, matcher: Matcher) -> Iterator[pa.RecordBatch]:
    """Documents whose matches depend on terms outside the templates come with those and their text, undecided."""
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            texts = batch.column("text").to_pylist()
            pieces = [matcher.pieces(t or "") for t in texts]
            wanted = [matcher.open_terms(p) if p else None for p in pieces]
            found = [matcher.decide(p) if w == [] else None for p, w in zip(pieces, wanted, strict=True)]
            held = pa.array([t if w else None for t, w in zip(texts, wanted, strict=True)], pa.string())
            yield _rows(batch, found, ("open_text", held), ("open_terms", pa.array(wanted, pa.list_(pa.string()))))


def _decide(batches, matcher: Matcher) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            others = [{w["term"]: matcher.weight(w["n"]) for w in ws} for ws in batch.column("weights").to_pylist()]
            yield _rows(batch, [matcher.decide(matcher.pieces(t), o) for t, o in zip(batch.column("open_text").to_pylist(), others, strict=True)])


def found_licenses(placed: DataFrame, matcher: Matcher, counted: DataFrame) -> DataFrame:
    """Every document's own licence: the columns of ``FOUND``."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    found = materialize(map_arrow(placed, functools.partial(_scan, matcher=matcher), FOUND + ", open_text string, open_terms array<string>"), "licenses")
    done, opened = found.where(F.col("open_text").isNull()).select(*names), found.where(F.col("open_text").isNotNull())
    if opened.isEmpty():
        return done
    opened = materialize(opened.withColumn("at", F.monotonically_increasing_id()), "open-licenses")
    wanted = opened.select("at", F.explode("open_terms").alias("term"))
    weights = wanted.join(counted, "term").groupBy("at").agg(F.collect_list(F.struct("term", "n")).alias("weights"))
    decided = map_arrow(opened.select("at", "doc_id", "directory", "path", "open_text").join(weights, "at"), functools.partial(_decide, matcher=matcher), FOUND)
    return materialize(done.unionByName(decided), "decided-licenses")


def frequencies(docs: DataFrame) -> DataFrame:
    """``term, n``: how many documents hold it; the null term counts all."""
    counted = map_arrow(docs.select(F.col("text").cast("string").alias("text")), _count, "term string, n long")
    return materialize(counted.groupBy("term").agg(F.sum("n").alias("n")), "term-frequencies")


def matcher(counted: DataFrame, templates=TEMPLATES, least: float = LEAST) -> Matcher:
    """With the frequencies of the templates' terms, one number for each of which comes to the driver."""
    known = sorted({t for _, text in templates for t in terms(text)})
    frequency = {r["term"]: r["n"] for r in counted.where(F.col("term").isNull() | F.col("term").isin(known)).collect()}
    documents = frequency.pop(None, 0)
    return Matcher(templates, {t: frequency.get(t, 0) for t in known}, documents, least)


def scan(docs: DataFrame, directory: Column, name: Column, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """``doc_id, path, own_license, score, line, license, inherited_from`` for every document.

    ``directory`` is its folder (parts joined by slashes), ``name`` its file name. ``license`` is the
    document's own licence or the inherited one; ``inherited_from`` is the directory that gave it.
    """
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), directory.alias("directory"), F.concat_ws("/", directory, name).alias("path"), F.col("text").cast("string").alias("text"))
    counted = frequencies(docs)
    found = found_licenses(placed, matcher(counted, templates, least), counted)

    votes = found.where("is_license_file").groupBy("directory", "own_license").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("directory").orderBy(F.desc("n"), "own_license"))
    given = votes.withColumn("k", first).where(F.col("k") == 1).select(F.col("directory").alias("ancestor"), F.col("own_license").alias("theirs"))
    parts = F.split("directory", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    steps = found.select("directory").distinct().select("directory", F.posexplode(up).alias("depth", "ancestor"))
    nearest = F.row_number().over(Window.partitionBy("directory").orderBy(F.desc("depth")))
    # Written out, it is one small table to join with, so that a crowded directory can be split or need not move at all.
    heirs = materialize(steps.join(given, "ancestor").withColumn("k", nearest).where(F.col("k") == 1).select("directory", "ancestor", "theirs"), "heirs")

    own = F.col("own_license").isNotNull()
    return found.join(heirs, "directory", "left").select(
        "doc_id", "path", "own_license", "score", "line",
        F.coalesce("own_license", "theirs").alias("license"),
        F.when(~own, F.col("ancestor")).alias("inherited_from"),
    )


def tree() -> tuple[Column, Column]:
    """Directory and name of ``documents`` as a tree: of ten documents one lies with its language, of a hundred one with its source, all others on a shelf of a thousand ids."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    source, lang, n = part("source"), part("lang"), F.col("doc_id").cast("long")
    shelf = F.coalesce(F.floor(n / SHELF).cast("string"), F.lit("_"))
    directory = F.when(F.pmod(n, F.lit(100)) == 0, source).when(F.pmod(n, F.lit(10)) == 0, F.concat_ws("/", source, lang)).otherwise(F.concat_ws("/", source, lang, shelf))
    return directory, F.concat(part("doc_id"), F.lit(".txt"))


def report(docs: DataFrame) -> DataFrame:
    """The scan over the :func:`tree` of ``documents``."""
    return scan(docs, *tree())
