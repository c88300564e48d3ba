"""Licence scan: texts compared to licence templates by the Dice coefficient of
their sets of word bigrams.

A document is compared as a whole, by paragraphs (between blank lines) and by
lines, and by windows over its sequence of words across line and paragraph
breaks, so that a notice inside a long text is found however it is laid out.  A
coefficient of t needs the smaller set to have at least t / (2 - t) of the
larger one's bigrams, so only templates of fitting size are looked at, and a
window is at most (2 - t) / t times as long as its template.  Bigrams at its
ends that the template lacks only lower its coefficient, so windows start and
end with the template's bigrams; and they need t / (2 - t) of the template's
bigrams, so stretches with fewer are skipped.  Both lose nothing.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD_PERCENT = 80

# Public licence notices, the short grants in full.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
        or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mit-line": "Released under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
        OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution.""",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed
        in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}
NOT_WORD = re.compile(r"[^A-Za-z0-9\n]+")
BLANK = re.compile(r"\n(?: *\n)+")


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def words_of(text: str) -> list[str]:
    return NOT_WORD.sub(" ", text).lower().split()


class Scanner:
    def __init__(self, percent: int = THRESHOLD_PERCENT, templates: dict[str, str] | None = None):
        sets = {name: bigrams(words_of(text)) for name, text in (templates or TEMPLATES).items()}
        self.percent = percent
        self.by_size = sorted((len(s), name) for name, s in sets.items() if s)
        self.sizes = [n for n, _ in self.by_size]
        self.sets = sets
        self.known = frozenset().union(*sets.values())
        self.lengths = {name: len(words_of(text)) - 1 for name, text in (templates or TEMPLATES).items()}

    def best(self, found: set[tuple[str, str]]) -> tuple[int, int, str] | None:
        """``(shared, both sizes, template)`` of the most alike template in reach."""
        n, p, best = len(found), self.percent, None
        lo = bisect_left(self.sizes, -(-p * n // (200 - p)))
        hi = bisect_right(self.sizes, (200 - p) * n // p)
        for size, name in self.by_size[lo:hi]:
            shared = len(found & self.sets[name])
            if 200 * shared >= p * (n + size):
                this = (shared, n + size, name)
                # larger coefficient first, then the smaller name
                if best is None or (shared * best[1], best[2]) > (best[0] * this[1], name) and shared * best[1] >= best[0] * this[1]:
                    best = this
        return best

    def windows(self, words: list[str], own: set[tuple[str, str]] | None = None) -> Iterator[tuple[int, int, str, int, int]]:
        """``(shared, both sizes, template, first word, last word)`` of the most
        alike window that reaches a template, for each template and first word."""
        grams = list(zip(words, words[1:]))
        own = set(grams) if own is None else own
        p = self.percent
        at: dict[tuple[str, str], list[int]] | None = None
        for size, name in self.by_size:
            template = self.sets[name]
            least, most, longest = -(-p * size // (200 - p)), (200 - p) * size // p, (200 - p) * self.lengths[name] // p
            common = own & template
            if len(common) < least:
                continue
            if at is None:
                at = {}
                for i, gram in enumerate(grams):
                    if gram in self.known:
                        at.setdefault(gram, []).append(i)
            places = sorted(i for gram in common for i in at[gram])
            for k in range(len(places) - least + 1):
                first = places[k]
                if places[k + least - 1] - first >= longest:
                    continue
                found: set[tuple[str, str]] = set()
                top, shared, done = None, 0, first
                for last in places[k:bisect_left(places, first + longest, k)]:
                    new = grams[last] not in found
                    found.update(grams[done:last + 1])
                    done = last + 1
                    if len(found) > most:
                        break
                    shared += new
                    both = len(found) + size
                    if 200 * shared >= p * both and (top is None or shared * top[1] > top[0] * both):
                        top = shared, both, name, first, last + 1
                if top:
                    yield top

    def scan(self, text: str) -> tuple[str, float, int] | None:
        """``(licence, coefficient, places)`` of the best of all parts and windows."""
        plain = NOT_WORD.sub(" ", text).lower()
        words = plain.split()
        whole = bigrams(words)
        if whole.isdisjoint(self.known):
            return None
        hits, spans, at = [], [], 0  # spans: first and last word of the parts that reach a template

        def look(part: list[str], start: int) -> None:
            if len(part) > 1 and not (found := bigrams(part)).isdisjoint(self.known) and (hit := self.best(found)):
                hits.append(hit)
                spans.append((start, start + len(part) - 1))

        for line in plain.split("\n"):
            part = line.split()
            look(part, at)
            at += len(part)
        paragraphs, at = BLANK.split(plain), 0
        for paragraph in paragraphs:
            part = paragraph.split()
            if "\n" in paragraph.strip("\n "):
                look(part, at)
            at += len(part)
        if len(paragraphs) > 1:
            look(words, 0)
        found = sorted(self.windows(words, whole), key=lambda w: (w[3], w[4]))
        places = len(hits) + _further(spans, [w[3:] for w in found])
        hits += [w[:3] for w in found]
        if not hits:
            return None
        top = hits[0]
        for hit in hits[1:]:
            if hit[0] * top[1] > top[0] * hit[1] or hit[0] * top[1] == top[0] * hit[1] and hit[2] < top[2]:
                top = hit
        return top[2], 2 * top[0] / top[1], places


def _further(spans: list[tuple[int, int]], windows: list[tuple[int, int]]) -> int:
    """How many groups of overlapping windows (sorted) share no word with a span."""
    groups: list[list[int]] = []
    for first, last in windows:
        if groups and first <= groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], last)
        else:
            groups.append([first, last])
    ends, k, n = sorted(spans), 0, 0
    reach = -1  # last word of the spans that start before the group ends
    for first, last in groups:
        while k < len(ends) and ends[k][0] <= last:
            reach = max(reach, ends[k][1])
            k += 1
        n += reach < first
    return n


@functools.lru_cache(maxsize=4)
def scanner(percent: int) -> Scanner:
    return Scanner(percent)


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per row of ``df``: ``id, licence, dice, places``: the most alike
    template of any part or window of the text (null if none reaches
    ``percent``), its coefficient (0 if none) and how many parts reach a
    template, with the places that only windows reach.

    Ties go to the smaller template name.  Null and empty texts, and texts with
    fewer than two words, find nothing.  Null and repeated ids are kept row by
    row; an empty table gives no rows.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(percent).scan
        for batch in batches:
            got = [scan(t) if t else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([g and g[0] for g in got], pa.string()), pa.array([g[1] if g else 0.0 for g in got], pa.float64()),
                 pa.array([g[2] if g else 0 for g in got], pa.int64())], ["id", "licence", "dice", "places"])

    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "id long, licence string, dice double, places long"))
