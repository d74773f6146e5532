r"""Licence scan: Dice coefficient over word bigrams against templates.

Text is normalised (A-Z lower-cased, punctuation and white space between words
dropped) to one sequence of words, across lines and paragraphs.  A run of consecutive
words matches a template if the Dice coefficient of their multisets of word bigrams
reaches ``threshold``; the best run counts.

Pruning loses no match.  Size bound: at Dice t, a run has between t/(2-t) and (2-t)/t
times as many bigrams as the template.  Ends: a run that begins or ends with a bigram
that the template lacks is no better than without it, so runs go from one shared bigram
to another; fewer than t/(2-t) of the template's bigrams within the longest size rule a
start out.  Anchors: a match shares at least t/(2-t) of a template's bigrams, so of any
set that is larger than the rest one occurs in the text; other texts are passed over.

Defined cases: null or empty text matches nothing (no licences, null best, score
0); repeated rows each get a row; ties in the score go to the name that sorts
first; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Licence notices and texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License.",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "All rights reserved": "All rights reserved.",
}

FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Templates:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        low = threshold / (2 - threshold)
        self.rows = []
        for name, text in sorted(templates.items()):
            words = words_of(text.encode())
            grams = Counter(zip(words, words[1:]))
            n = sum(grams.values())
            if not n:
                continue
            # more bigrams than a match may lack, those with the longest words first; the longer word stands for each
            need = math.ceil(low * n - 1e-9)
            pool = sorted(grams.elements(), key=lambda g: (-max(map(len, g)), g))[:n - need + 1]
            self.rows.append((name, grams, n, math.ceil(low * n - 1e-9), math.floor(n / low + 1e-9), frozenset(max(g, key=len) for g in pool)))
        self.anchors = frozenset().union(*[r[5] for r in self.rows])

    def matches(self, text: bytes) -> dict[str, tuple[float, int]]:
        """Name -> (best Dice coefficient, matching runs that do not overlap, the better first)."""
        words = words_of(text)
        have = self.anchors.intersection(words)
        out: dict[str, tuple[float, int]] = {}
        if not have:
            return out
        grams = list(zip(words, words[1:]))
        for name, own, m, least, most, anchors in self.rows:
            if not anchors.isdisjoint(have):
                runs = self._runs(grams, own, m, least, most)
                if runs:
                    taken: list[int] = []            # bounds of the runs counted, ascending
                    for _, a, b in runs:
                        at = bisect.bisect_right(taken, a)
                        if at % 2 == 0 and (at == len(taken) or taken[at] >= b):
                            taken[at:at] = [a, b]
                    out[name] = -runs[0][0], len(taken) // 2
        return out

    def _runs(self, grams: list, own: Counter, m: int, least: int, most: int) -> list[tuple[float, int, int]]:
        """(-Dice, first, last + 1) of the best matching run from each start, the best first."""
        at = [i for i, g in enumerate(grams) if g in own]
        found = []
        for k, a in enumerate(at):
            if k + least > len(at) or at[k + least - 1] - a >= most:
                continue
            left, shared, best = dict(own), 0, (0.0, 0)
            for b in at[k:bisect.bisect_left(at, a + most, k)]:
                g = grams[b]
                if left[g]:
                    left[g] -= 1
                    shared += 1
                    dice = 2 * shared / (b - a + 1 + m)
                    if dice > best[0]:
                        best = dice, b + 1
            if best[0] >= self.threshold:
                found.append((-best[0], a, best[1]))
        return sorted(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, licences (sorted names), best, score (the best's Dice
    coefficient), n_units (runs that match, counted per template)."""
    known = Templates(templates or TEMPLATES, threshold)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))

    def each(batches):
        for b in batches:
            found = [known.matches(t.as_py() or b"") for t in b.column(1)]
            best = [min(f, key=lambda k: (-f[k][0], k)) if f else None for f in found]
            yield pa.record_batch([b.column(0), pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.array(best, pa.string()),
                                   pa.array([f[k][0] if k else 0.0 for f, k in zip(found, best)], pa.float64()),
                                   pa.array([sum(x[1] for x in f.values()) for f in found], pa.int64())],
                                  ["id", "licences", "best", "score", "n_units"])

    return rows.mapInArrow(each, f"id {dict(rows.dtypes)['id']}, licences array<string>, best string, score double, n_units long").withColumnRenamed("id", id_col)
