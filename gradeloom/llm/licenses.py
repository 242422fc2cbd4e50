"""License scans by patience alignment.

Text and template are words. Words that occur once in both anchor the alignment: the longest increasing subsequence
of their positions is kept, and the gaps between anchors are aligned in the same way; in a gap without unique
common words the equal words at its ends are matched. Coverage is the matched share of the template's words,
within a stretch of the text; a template is found from ``COVER`` on, in a stretch of less than twice its length. Notices are looked
for at their usual length first; where that finds none, with as many words put in as the template has itself. The window search starts at each occurrence of the
template's rarest words, so texts are read whole and each occurrence counts. There are so many of these words that
a find without any of them would miss more words than ``COVER`` allows; texts and windows without enough of a template's
words are left out before the alignment, which couldn't match more.

Cases: null and empty texts have no license; several occurrences and several templates give a row each in
Scanner, of overlapping ones that with the most words, then the closest; ``best`` gives the best by coverage, then length, then place; repeated rows are scanned each; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .shared import prepare

COVER = 0.8
WORD = re.compile(r"[^\W_]+(?:[.-][0-9]+)*")

#: Licenses and notices in public use, by SPDX identifier.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause-full": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "ARR": "All rights reserved.",
}


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(WORD.finditer(text))
    return [m[0].lower() for m in found], [m.span() for m in found]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first) whose second parts increase: patience piles."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        p = bisect_left(tops, b)
        if p == len(tops):
            tops.append(b)
            last.append(k)
        else:
            tops[p], last[p] = b, k
        back[k] = last[p - 1] if p else -1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Matched positions of a and b, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        ca, cb = Counter(a[i0:i1]), Counter(b[j0:j1])
        at = {w: j for j, w in enumerate(b[j0:j1], j0) if cb[w] == 1}
        anchors = increasing([(i, at[w]) for i, w in enumerate(a[i0:i1], i0) if ca[w] == 1 and w in at])
        if anchors:
            out += anchors
            ends = [(i0 - 1, j0 - 1), *anchors, (i1, j1)]
            todo += [(x[0] + 1, y[0], x[1] + 1, y[1]) for x, y in zip(ends, ends[1:])]
    return sorted((i + a0, j + b0) for i, j in out)


def densest(match: list[tuple[int, int]], words_: int) -> list[tuple[int, int]]:
    """The most matches within so many words of the text."""
    best, first = (0, 0), 0
    for last, (i, _) in enumerate(match):
        while i - match[first][0] >= words_:
            first += 1
        if last + 1 - first > best[1] - best[0]:
            best = (first, last + 1)
    return match[best[0] : best[1]]


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.templates = {k: w for k, t in sorted(templates.items()) if (w := words(t)[0])}
        df = Counter(w for t in self.templates.values() for w in set(t))
        #: Words that a find may miss, by the very comparison that accepts it.
        self.spare = {k: max(m for m in range(len(t) + 1) if (len(t) - m) / len(t) >= COVER) for k, t in self.templates.items()}
        self.counts = {k: sorted(Counter(t).items(), key=lambda x: (df[x[0]], -len(x[0]), x[0])) for k, t in self.templates.items()}
        self.keys = {}
        for k, counts in self.counts.items():  # rarest first, until a find can't miss them all
            total, keys = 0, self.keys.setdefault(k, {})
            for w, n in counts:
                if total <= self.spare[k]:
                    keys[w] = [j for j, x in enumerate(self.templates[k]) if x == w]
                total += n

    def open(self, name: str, has) -> bool:
        """Whether the words that are there can make a find; has gives a word's count, or whether it is there."""
        left = self.spare[name]
        for w, n in self.counts[name]:
            there = has(w)
            if there is not True and there < n and (left := left - n + there) < 0:
                return False
        return True

    def __call__(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end in code points) of every find."""
        low = text.lower()
        names = [name for name in self.templates if self.open(name, low.__contains__)]
        if not names:
            return []
        toks, at = words(text)
        where: dict[str, list[int]] = {}
        wanted = {w for name in names for w in self.keys[name]}
        for i, w in enumerate(toks):
            if w in wanted:
                where.setdefault(w, []).append(i)
        out = []
        for name in names:
            t = self.templates[name]
            starts = sorted({i - j for w, places in self.keys[name].items() for i in where.get(w, ()) for j in places})
            done = -1
            for s in starts:
                if s + len(t) <= done:
                    continue
                for before, after in ((len(t) // 2, len(t) + len(t) // 2 + 1), (2 * len(t), 3 * len(t))):
                    lo, hi = max(0, s - before, done), min(len(toks), s + after)
                    if not self.open(name, Counter(toks[lo:hi]).__getitem__):
                        continue
                    match = densest(align(toks[lo:hi], t, lo), 2 * len(t))
                    cover = len(match) / len(t)
                    if cover >= COVER:
                        span = match[-1][0] + 1 - match[0][0]
                        out.append((name, cover, at[match[0][0]][0], at[match[-1][0]][1], len(match), len(match) / max(span, len(t))))
                        done = match[-1][0] + 1
                        break
        out.sort(key=lambda f: (-f[4], -f[5], -f[1], f[0]))
        kept: list[tuple] = []
        for f in out:  # of finds that overlap, the one with the most words, then the closest
            if all(f[3] <= g[2] or g[3] <= f[2] for g in kept):
                kept.append(f)
        return [f[:4] for f in sorted(kept, key=lambda f: f[2])]


def best(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """docs(..., text) with license, coverage, start, end (null where none), n_finds."""
    prepare(docs.sparkSession)
    at, templates = docs.columns.index("text"), templates or TEMPLATES
    new = [StructField("license", StringType()), StructField("coverage", DoubleType()), StructField("start", LongType()), StructField("end", LongType()), StructField("n_finds", LongType())]
    schema = StructType([*docs.schema.fields, *new])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = []
            for t in batch.column(at).to_pylist():
                finds = scanner(t or "")
                top = max(finds, key=lambda f: (f[1], f[3] - f[2], -f[2], f[0])) if finds else (None,) * 4
                rows.append((*top, len(finds)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds))], schema.names)

    return docs.mapInArrow(scan, schema)
