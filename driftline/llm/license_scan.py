"""License scans: a generalised suffix automaton of license templates.

The automaton holds every run of words of every template.  Words of a text are streamed through
it, which gives at each word the longest run ending there that some template contains (the
matching statistics).  Maximal runs of ``LEAST_RUN`` words or more are chained, in order, within
one template, across gaps of at most ``MOST_GAP`` words on either side; a chain that covers
``LEAST_COVER`` of its template is a span with the template's label.  Of chains that overlap, in
licenses that share their words, the one with the most words is emitted; all others are, wherever
they are in the text.

A text's words that no template has can't be part of a run, so only stretches of known words
that are long enough pass through the automaton.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import batches_out, table

LEAST_RUN = 4
MOST_GAP = 8
LEAST_COVER = 0.5
#: The score of a text with a base phrase whose spans score less.
BASE_SCORE = 0.5

# Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices and texts of public licenses.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
    "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, what: str, version: str) -> str:
    return (
        f"{what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
        f"Foundation, either version {version} of the License, or (at your option) any later version. {what} is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        f"the {name} for more details."
    )


TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", _MIT_GRANT),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("mit", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    (
        "apache",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, "
        "no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, "
        "sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", _gnu("GNU General Public License", "This program", "3")),
    ("gpl", _gnu("GNU General Public License", "This program", "2")),
    ("lgpl", _gnu("GNU Lesser General Public License", "This library", "2.1")),
    ("lgpl", _gnu("GNU Lesser General Public License", "This program", "3")),
    ("agpl", _gnu("GNU Affero General Public License", "This program", "3")),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("bsd", _BSD_TWO),
    ("bsd-2-clause", f"{_BSD_TWO} {_BSD_WARRANTY}"),
    ("bsd-3-clause", f"{_BSD_TWO} {_BSD_THIRD}"),
    ("bsd-3-clause", f"{_BSD_TWO} {_BSD_THIRD} {_BSD_WARRANTY}"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely.",
    ),
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(W.LETTERS_AND_DIGITS).split()


@dataclass
class State:
    length: int
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    ends: set[tuple[int, int]] = field(default_factory=set)


class Automaton:
    """A generalised suffix automaton over the templates' words, numbered from 1; 0 is any other word."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.labels = [label for label, _ in templates]
        texts = [words_of(text) for _, text in templates]
        self.lengths = [len(t) for t in texts]
        self.number: dict[bytes, int] = {}
        for t in texts:
            for w in t:
                self.number.setdefault(w, len(self.number) + 1)
        self.states = [State(0)]
        for n, t in enumerate(texts):
            last = 0
            for end, w in enumerate(t, 1):
                last = self._add(last, self.number[w])
                self.states[last].ends.add((n, end))
        for s in sorted(range(1, len(self.states)), key=lambda s: -self.states[s].length):
            self.states[self.states[s].link].ends |= self.states[s].ends
        self.states[0].ends = set()

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q that stands for its runs no longer than p's with c after them."""
        states = self.states
        states.append(State(states[p].length + 1, states[q].link, dict(states[q].next)))
        copy = len(states) - 1
        while p >= 0 and states[p].next.get(c) == q:
            states[p].next[c] = copy
            p = states[p].link
        states[q].link = copy
        return copy

    def _add(self, last: int, c: int) -> int:
        states = self.states
        if c in states[last].next:
            q = states[last].next[c]
            return q if states[q].length == states[last].length + 1 else self._split(last, q, c)
        states.append(State(states[last].length + 1))
        new = len(states) - 1
        p = last
        while p >= 0 and c not in states[p].next:
            states[p].next[c] = new
            p = states[p].link
        if p < 0:
            states[new].link = 0
        else:
            q = states[p].next[c]
            states[new].link = q if states[q].length == states[p].length + 1 else self._split(p, q, c)
        return new

    def statistics(self, codes: list[int]) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest run that ends at each word."""
        states, s, n = self.states, 0, 0
        for c in codes:
            while s and c not in states[s].next:
                s = states[s].link
                n = states[s].length
            if c in states[s].next:
                s = states[s].next[c]
                n += 1
            else:
                s = n = 0
            yield n, s

    def runs(self, codes: list[int], least: int = LEAST_RUN) -> list[tuple[int, int, int]]:
        """Maximal (end, length, state): runs of ``least`` words or more that the next word doesn't lengthen."""
        seen = [*self.statistics(codes), (0, 0)]
        return [(i + 1, n, s) for i, ((n, s), (after, _)) in enumerate(zip(seen, seen[1:], strict=False)) if n >= least and after <= n]

    def spans(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, words covered, share of the template) of the chains that cover enough; of those that overlap, the one with the most words."""
        by_template: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for end, n, s in runs:
            for template, at in self.states[s].ends:
                by_template[template].append((end, at, n))
        found: dict[str, list[tuple[str, int, int, int, float]]] = defaultdict(list)
        for template, matches in sorted(by_template.items()):
            matches.sort()
            chains: list[tuple[int, int]] = []
            for i, (end, at, n) in enumerate(matches):
                covered, first = n, end - n
                for j in range(i - 1, -1, -1):
                    e, a, _ = matches[j]
                    if end - n - e > MOST_GAP:
                        break
                    if a < at and e < end and at - n - a <= MOST_GAP:
                        fresh = min(n, end - e, at - a)
                        if chains[j][0] + fresh > covered:
                            covered, first = chains[j][0] + fresh, chains[j][1]
                chains.append((covered, first))
                share = min(1.0, covered / self.lengths[template])
                if share >= LEAST_COVER:
                    found[self.labels[template]].append((self.labels[template], first, end, covered, share))
        kept: list[tuple[str, int, int, int, float]] = []
        # chosen spans don't overlap, so the nearest on either side decide
        starts: list[int] = []
        ends: list[int] = []
        for span in sorted((x for spans in found.values() for x in spans), key=lambda s: (-s[3], -s[4], s[0])):
            at = bisect_left(starts, span[2])
            if not at or ends[at - 1] <= span[1]:
                starts.insert(at, span[1])
                ends.insert(at, span[2])
                kept.append(span)
        return sorted(kept, key=lambda s: (s[1], s[0]))


_SPAN = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("covered", T.LongType()),
        T.StructField("share", T.DoubleType()),
    ]
)
_PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType())])


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """key, n_words, places of the base phrases, and spans of templates, for every row.

    Starts and ends count words from 0.  A null text counts as empty; repeated rows are scanned
    one by one.
    """
    out = T.StructType([docs.schema[key], T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(_PLACE)), T.StructField("spans", T.ArrayType(_SPAN))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        automaton = Automaton(templates)
        number = dict(automaton.number)
        wanted = []
        for phrase, label in phrases:
            wanted.append(([number.setdefault(w, len(number) + 1) for w in words_of(phrase)], label))
        for whole in batches:
            for batch in W.chunks(whole):
                found = W.split(batch.column(1), W.LETTERS_AND_DIGITS)
                numbers = np.array([number.get(w, 0) for w in found.distinct] + [0], np.int32)
                codes, offsets = numbers[found.codes], found.offsets
                places: dict[int, list[dict]] = defaultdict(list)
                for phrase, label in wanted:
                    n = len(phrase)
                    if len(codes) < n:
                        continue
                    hit = codes[: len(codes) - n + 1] == phrase[0]
                    for k in range(1, n):
                        hit = hit & (codes[k : len(codes) - n + 1 + k] == phrase[k])
                    at = np.flatnonzero(hit)
                    owner = np.searchsorted(offsets, at, "right") - 1
                    for p, o in zip(at.tolist(), owner.tolist(), strict=True):
                        if p + n <= offsets[o + 1]:
                            places[o].append({"label": label, "start": p - int(offsets[o])})
                known = np.concatenate([[False], codes > 0, [False]])
                edges = np.flatnonzero(known[1:] != known[:-1])
                starts, ends = edges[::2], edges[1::2]
                runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
                long = ends - starts >= LEAST_RUN
                for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
                    o = int(np.searchsorted(offsets, a, "right")) - 1
                    while a < b:
                        stop = min(b, int(offsets[o + 1]))
                        base = int(offsets[o])
                        if stop - a >= LEAST_RUN:
                            runs[o] += [(a - base + e, n, s) for e, n, s in automaton.runs(codes[a:stop].tolist())]
                        a = stop
                        o += 1
                for o, k in enumerate(batch.column(0).to_pylist()):
                    spans = automaton.spans(runs[o]) if o in runs else []
                    yield k, int(offsets[o + 1] - offsets[o]), sorted(places.get(o, []), key=lambda p: p["start"]), [dict(zip(_SPAN.names, s, strict=True)) for s in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_out(rows(batches), out)

    return docs.select(key, text).mapInArrow(run, out)


def digest(scanned: DataFrame) -> DataFrame:
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    method = F.transform("spans", lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, method)).alias("labels"),
        F.greatest(best, F.when(F.size("places") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's places and labels: a null text is empty, repeated rows are scanned one by one, an empty table gives no rows."""
    return digest(scan(table(spark, sf_dir, "documents")))
