"""License notices by patience alignment.

Texts and templates are words of small letters and digits. Words that occur
once in a window of the text and once in the template are anchors; the longest
increasing subsequence of their places is kept, equal words at either end of a
gap are matched, and each gap between anchors is aligned in the same way. A
template is found where ``COVERAGE`` of its words are matched.

A copy may have words put in between, up to ``SPREAD`` times the template's
length in all: windows begin at each of the template's words in the text and
have the template's length, twice that, and so on up to SPREAD times; the one
that matches most, the shortest of equal ones, is a find if it reaches the
coverage. In longer ones copies side by side leave no word unique. Only windows that
cannot reach the coverage are left out unaligned: by the words that they have
at all, which are counted as windows slide over the text, and only near the
template's words that are rarest in it. ``find`` is tested against the same
search without these.

Defined results: a null or empty text has no notices; overlapping finds of one
template count once, the best of them; repeated rows each get their row.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from .common import as_documents, column, mapped

COVERAGE, SPREAD = 0.8, 4

# Short notices and the opening parts of public licenses, by SPDX name.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    ],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0"],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2"],
    "GPL-3.0": ["Licensed under the GNU General Public License, version 3", "This work is licensed under the GNU General Public License, version 3", "either version 3 of the License, or (at your option) any later version"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3"],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, in order of the first, whose second increases."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back[i] = at[k - 1] if k else -1
        tails[k : k + 1] = [b]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        places = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        anchors = _increasing([(i, places[w]) for i, w in enumerate(a[a0:a1], a0) if w in places])
        out += anchors
        last_a, last_b = a0, b0
        for i, j in [*anchors, (a1, b1)] if anchors else ():
            gaps.append((last_a, i, last_b, j))
            last_a, last_b = i + 1, j + 1
    return sorted(out)


def disjoint(found: list[tuple], value) -> list[tuple]:
    """Of finds (..., first, last, ...) that overlap the one of most ``value``, in order of place."""
    taken: list[tuple[int, int]] = []
    out = []
    for x in sorted(found, key=value):
        first, last = x[1], x[2]
        i = bisect_left(taken, (first, last))
        if (i == len(taken) or last < taken[i][0]) and (not i or taken[i - 1][1] < first):
            insort(taken, (first, last))
            out.append(x)
    return sorted(out, key=lambda x: (x[1], x[0]))


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, coverage: float = COVERAGE, spread: int = SPREAD):
        self.coverage, self.spread = coverage, spread
        self.templates = [(name, w, Counter(w)) for name, texts in sorted(templates.items()) for w in (words_of(t.encode()) for t in texts)]
        self.words = {w for _, t, _ in self.templates for w in t}

    def at(self, words: list[bytes], template: list[bytes], start: int) -> tuple[float, int, int] | None:
        """(coverage, first, last) of the window from ``start`` on that matches most, if that is enough."""
        n, best = len(template), []
        for k in range(1, self.spread + 1):
            pairs = align(words[start : start + k * n], template)
            if len(pairs) > len(best):
                best = pairs
            if len(best) == n or start + k * n >= len(words):
                break
        return (len(best) / n, start + best[0][0], start + best[-1][0]) if len(best) >= self.coverage * n else None

    def starts(self, words: list[bytes], template: list[bytes], bag: Counter, places: dict[bytes, list[int]]) -> list[int]:
        """The places of template words from which the longest window has words enough."""
        n, wide = len(template), self.spread * len(template)
        if sum(min(k, len(places.get(w, ()))) for w, k in bag.items()) < self.coverage * n:
            return []
        # a find misses (1 - coverage) of the words at most, so one of these, the rarest, is in it
        keys, missing = [], 0
        for w in sorted(bag, key=lambda w: (len(places.get(w, ())), w)):
            keys += places.get(w, ())
            missing += bag[w]
            if missing > n - self.coverage * n:
                break
        keys = np.sort(np.array(keys, np.int64))
        every = np.sort(np.concatenate([np.array(places.get(w, ()), np.int64) for w in bag]))
        following = np.searchsorted(keys, every)
        near = np.zeros(len(every), bool)
        inside = following < len(keys)
        near[inside] = keys[following[inside]] < every[inside] + wide
        out, have, total, end = [], Counter(), 0, 0
        listed = every.tolist()
        for i, ok in enumerate(near.tolist()):
            if not ok:
                have, total, end = Counter(), 0, max(end, i + 1)
                continue
            if not have:
                end = i
            while end < len(listed) and listed[end] < listed[i] + wide:
                w = words[listed[end]]
                have[w] += 1
                total += have[w] <= bag[w]
                end += 1
            if total >= self.coverage * n:
                out.append(listed[i])
            w = words[listed[i]]
            total -= have[w] <= bag[w]
            have[w] -= 1
            if not have[w]:
                del have[w]
        return out

    def find(self, text: bytes) -> list[tuple[str, int, int, float, int]]:
        """(template, first word, last word, coverage, matched words) in order."""
        words = words_of(text)
        places: dict[bytes, list[int]] = {}
        known = self.words
        for i, w in enumerate(words):
            if w in known:
                places.setdefault(w, []).append(i)
        out: list[tuple[str, int, int, float, int]] = []
        for name, template, bag in self.templates:
            found = {self.at(words, template, s) for s in self.starts(words, template, bag, places)}
            out += disjoint([(name, a, b, c, round(c * len(template))) for c, a, b in found - {None}], lambda x: (-x[3], x[2] - x[1], x[1]))
        return sorted(out, key=lambda x: (x[1], x[0]))


def best_at_each_place(found: list[tuple[str, int, int, float, int]]) -> list[tuple[str, int, int, float, int]]:
    """Of finds that overlap, the one with most matched words, then the shortest."""
    return disjoint(found, lambda x: (-x[4], x[2] - x[1], x[0], x[1]))


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_notices, licenses, best_coverage and spans (name:first word:last word), a row a document."""
    scanner = Scanner(templates, coverage)

    def run(batch):
        made = [best_at_each_place(scanner.find(t)) for t in column(batch, "text").to_pylist()]
        return {
            "doc_id": column(batch, "doc_id"),
            "n_notices": [len(x) for x in made],
            "licenses": [",".join(sorted({y[0] for y in x})) for x in made],
            "best_coverage": [max((y[3] for y in x), default=0.0) for x in made],
            "spans": [",".join(f"{a}:{b}:{c}" for a, b, c, *_ in x) for x in made],
        }

    return mapped(as_documents(docs), run, "doc_id long, n_notices long, licenses string, best_coverage double, spans string")
