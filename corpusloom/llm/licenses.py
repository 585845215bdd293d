"""License scans by patience alignment of texts with templates.

A text and a template are aligned as a patience diff does: words that occur once in
both are anchors, the longest increasing subsequence of their places keeps the order,
and the gaps between anchors are aligned in the same way, after equal words at their
ends. A template's coverage is the share of its words that are aligned.

A match is a copy of a template in which at most as many foreign words stand as the
template has words, with a coverage of ``THRESHOLD`` or more. A long text may hold one
anywhere, and a word that is unique in a template may be frequent in a long text. So a
template is aligned in stretches of the text. They are found by counting: in any match so
many of the template's words are aligned that, whichever are not, a known number of its
less common ones must lie within twice the template's length. Places where so many do are
found for all texts of a batch at once; they and a template's length on either side are a
stretch, and no match lies outside. Where the places of ``GRAM`` words in a row fall back
in the template, it may stand again; a stretch is aligned in the parts between such places
too. Parts that hold more than half of the template are copies of it; where two are, a
better coverage of the whole stretch is one more match. Else it takes the place of the
parts that it overlaps.

Edge cases: null or empty text has no license; without a match license is null, coverage
and words aligned are 0; repeated rows each get a row; texts may have any length; of
matches with equal coverage the one of more words is reported, then the first by name;
other columns are ignored unless kept, and a made column replaces a kept one of its name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from corpusloom.llm.arrays import PrefixHash, column, map_text, mixed, words_of
from corpusloom.llm.decontaminate import normalised

#: Words so common in any text that they do not help to find a template.
COMMON = frozenset("a an and any at be by for from in is it of on or that the this to was with".split())
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

#: Whole texts of public licenses, notices that they ask to be kept, and short forms.
TEMPLATES = {
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_TAIL,
    "bsd-2-clause": _BSD_HEAD + _BSD_TAIL,
    "bsd-3-clause": _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL,
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL,
    "mit-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _AS_IS + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS + "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
GRAM = 3
THRESHOLD = 0.8
Pair = tuple[int, int]


def increasing(pairs: list[Pair]) -> list[Pair]:
    """A longest subsequence that increases in both places, by piles of patience."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back.append(piles[k - 1] if k else -1)
        tops[k : k + 1] = [b]
        piles[k : k + 1] = [i]
    out, at = [], piles[-1] if piles else -1
    while at >= 0:
        out.append(pairs[at])
        at = back[at]
    return out[::-1]


def align(text: list[bytes], template: list[bytes]) -> list[Pair]:
    """Aligned places of equal words, increasing in both, gap by gap."""
    found: list[Pair] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        once, own = Counter(text[a:b]), Counter(template[c:d])
        where = {w: j for j, w in enumerate(template[c:d], c) if own[w] == 1}
        anchors = increasing([(i, where[w]) for i, w in enumerate(text[a:b], a) if once[w] == 1 and w in where])
        for (i, j), (p, q) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            if anchors and p > i + 1 and q > j + 1:
                gaps.append((i + 1, p, j + 1, q))
        found += anchors
    return sorted(found)


Match = tuple[str, float, int, int, int]  #: template, coverage, words aligned, first word, word after the last


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of normalised texts, and how many words lie before each text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    rows = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends, first = words_of(data, rows)
    return (mixed(PrefixHash(data).of(starts, ends)) if len(data) else np.zeros(0, np.uint64)), first


class Scanner:
    """Templates ready to be found: their words, the fewest that a match must hold, their grams."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, threshold: float = THRESHOLD):
        self.gram, self.threshold = gram, threshold
        self.words = {name: normalised(t.encode()).split() for name, t in sorted(templates.items())}
        self.words = {name: own for name, own in self.words.items() if own}
        self.at: dict[tuple[str, bytes], list[int]] = {}
        self.known = np.unique(hashed_words([b" ".join(w for own in self.words.values() for w in own)])[0])
        self.tables: dict[str, tuple[np.ndarray, int]] = {}
        for name, own in self.words.items():
            for i in range(len(own) - gram + 1):
                self.at.setdefault((name, b" ".join(own[i : i + gram])), []).append(i)
            rare = [w for w in own if w.decode() not in COMMON]
            lost = len(own) - ceil(threshold * len(own) - 1e-9)  # words that a match may lack
            chosen = rare if len(rare) > lost else own
            table = np.zeros(len(self.known) + 1, bool)
            table[np.searchsorted(self.known, hashed_words([b" ".join(chosen)])[0])] = True
            table[-1] = False
            self.tables[name] = (table, len(chosen) - lost)

    def stretches(self, hashes: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
        """By text the (template, first word, word after the last) within which its matches lie."""
        out: dict[int, list[tuple[str, int, int]]] = {}
        if not len(self.known):
            return out
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        known = np.flatnonzero(self.known[at] == hashes)
        code, text = at[known], np.searchsorted(first, known, "right") - 1
        for name, (table, need) in self.tables.items():
            own = table[code]
            place, of = known[own], text[own]
            if len(place) < need:
                continue
            size, last = len(self.words[name]), len(place) - need + 1
            near = np.flatnonzero((place[need - 1 :] - place[:last] < 2 * size) & (of[need - 1 :] == of[:last]))
            for i in near.tolist():
                t = int(of[i])
                low, high = max(int(first[t]), int(place[i]) - size), min(int(first[t + 1]), int(place[i + need - 1]) + 1 + size)
                mine = out.setdefault(t, [])
                if mine and mine[-1][0] == name and low - first[t] <= mine[-1][2]:
                    mine[-1] = (name, mine[-1][1], max(mine[-1][2], high - int(first[t])))
                else:
                    mine.append((name, low - int(first[t]), high - int(first[t])))
        return out

    def parts(self, name: str, own: list[tuple[int, bytes]]) -> list[list[int]]:
        """A stretch's places, cut where the places in the template fall back."""
        out: list[list[int]] = []
        last = len(self.words[name])
        for place, gram in own:
            at = self.at[name, gram]
            k = bisect_right(at, last)
            if k == len(at):
                out.append([])
                k = 0
            last = at[k]
            out[-1].append(place)
        return out

    def scan(self, texts: list[bytes]) -> list[list[Match]]:
        """Matches of the threshold or more in each normalised text, best first."""
        found: list[list[Match]] = [[] for _ in texts]
        for t, own in self.stretches(*hashed_words(texts)).items():
            words = texts[t].split()
            every = [m for s in own for m in self.stretch(s[0], words, s[1], s[2]) if m[1] >= self.threshold]
            found[t] = sorted(set(every), key=lambda x: (-x[1], -x[2], x[0], x[3]))
        return found

    def stretch(self, name: str, words: list[bytes], low: int, high: int) -> list[Match]:
        """Matches of one stretch; none overlap but that of a stretch of several copies."""
        template = self.words[name]
        size = len(template)
        grams = (b" ".join(words[i : i + self.gram]) for i in range(low, high - self.gram + 1))
        own = [(i, g) for i, g in enumerate(grams, low) if (name, g) in self.at]

        def match(low: int, high: int) -> list[Match]:
            pairs = align(words[low:high], template)
            return [(name, len(pairs) / size, len(pairs), low + pairs[0][0], low + pairs[-1][0] + 1)] if pairs else []

        parts = self.parts(name, own)
        if len(parts) <= 1:
            return match(low, high)
        found = []
        for i, part in enumerate(parts):
            begin = min(part[0], max(low, part[0] - size, parts[i - 1][-1] + self.gram if i else 0))
            end = min(high, part[-1] + self.gram + size, parts[i + 1][0] if i + 1 < len(parts) else high)
            found += match(begin, max(end, part[-1] + self.gram))
        whole, several = match(low, high), sum(2 * f[2] > size for f in found) > 1
        if not several:
            found += whole
        out: list[Match] = []
        taken: list[Pair] = []  # in order, apart
        for f in sorted(found, key=lambda x: (-x[1], x[4] - x[3], x[3])):
            k = bisect_left(taken, (f[3], f[4]))
            if (k == 0 or taken[k - 1][1] <= f[3]) and (k == len(taken) or f[4] <= taken[k][0]):
                taken.insert(k, (f[3], f[4]))
                out.append(f)
        return out + [w for w in whole if several and w[1] > out[0][1]]


MATCH = StructType([StructField("license", StringType()), StructField("coverage", DoubleType()), StructField("start", LongType()), StructField("end", LongType())])
FIELDS = [
    StructField("n_words", LongType()),
    StructField("license", StringType()),
    StructField("coverage", DoubleType()),
    StructField("n_aligned", LongType()),
    StructField("matches", ArrayType(MATCH)),
]


_scanners: dict[tuple, Scanner] = {}


def _scanner(templates: tuple[tuple[str, str], ...], threshold: float) -> Scanner:
    """Made once in each worker process."""
    if (templates, threshold) not in _scanners:
        _scanners.clear()
        _scanners[templates, threshold] = Scanner(dict(templates), threshold=threshold)
    return _scanners[templates, threshold]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the best match, and all matches, which have a coverage of ``threshold`` or more.

    Starts and ends count the text's words.
    """
    chosen = tuple((TEMPLATES if templates is None else templates).items())

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        texts = [normalised(t) for t in column(batch, "text").cast(pa.binary()).to_pylist()]
        out: dict[str, list] = {f.name: [] for f in FIELDS}
        for plain, good in zip(texts, _scanner(chosen, threshold).scan(texts), strict=True):
            out["n_words"].append(plain.count(b" ") + bool(plain))
            out["license"].append(good[0][0] if good else None)
            out["coverage"].append(good[0][1] if good else 0.0)
            out["n_aligned"].append(good[0][2] if good else 0)
            out["matches"].append([{"license": n, "coverage": c, "start": a, "end": b} for n, c, _, a, b in good])
        return out

    return map_text(docs, list(keep), FIELDS, work)


def longest_common(text: list[bytes], template: list[bytes]) -> int:
    """Words of a longest common subsequence, by the plain table: what no alignment exceeds."""
    row = [0] * (len(template) + 1)
    for w in text:
        before = 0
        for j, v in enumerate(template, 1):
            before, row[j] = row[j], (before + 1 if v == w else max(row[j], row[j - 1]))
    return row[-1]
