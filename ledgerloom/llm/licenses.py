"""Licence scans: Dice coefficient over word bigrams against templates.

Texts and templates are normalised alike: A-Z folded, other ASCII than letters
and digits taken as space, white space collapsed. The units compared are every
line of a text, every paragraph (lines between blank lines) of more than one
line, and the whole text where it has more than one paragraph; a unit adds
nothing where one inside it has the same licence. Beside them every window of
two words or more is compared, over lines and paragraphs, and of the windows of
a template the best one that overlaps no better one is taken. A window adds
nothing where it overlaps a match of the same licence, or shares over half of
the shorter of the two with a match that has as many bigrams of its template.
Bigrams are counted with their multiplicity.

For Dice >= t, a unit of b bigrams can match a template of a bigrams only if
t / (2 - t) * a <= b <= (2 - t) / t * a; and of its bigrams at least the share
t / (2 - t) must occur in some template. Both bounds lose nothing and leave few
units, which are compared exactly. The best window begins and ends with bigrams
of its template and has at least t / (2 - t) * a of them within the upper bound,
so only such windows are compared.

Defined cases: null and empty texts match nothing; a template or unit of one
word has that word as its only "bigram", and is compared with units only; equal scores go to the template first
by name; repeated rows are each scanned; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import PLAIN, chunks

#: Public licence notices and short licence texts.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-line": "Released under the MIT License.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "all-rights-reserved-line": "Copyright. All rights reserved.",
}
KIND = "array<struct<license:string,dice:double,start:bigint,end:bigint>>"


def bigrams(h: np.ndarray) -> np.ndarray:
    """Hashes of the word bigrams; of a lone word, its own."""
    return h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) > 1 else h


def dice(a: Counter, b: Counter) -> float:
    return 2 * sum((a & b).values()) / max(1, a.total() + b.total())


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least, self.names = least, sorted(templates)
        parts = [bigrams(next(chunks(pa.array([templates[n]]), PLAIN)).word_hashes()) for n in self.names]
        self.bags = [Counter(p.tolist()) for p in parts]
        self.known = np.unique(np.concatenate(parts))
        self.bounds = [(least / (2 - least) * len(p), (2 - least) / least * len(p)) for p in parts]
        self.most = max(b for _, b in self.bounds)
        self.counts = [np.array([bag[int(g)] for g in self.known]) for bag in self.bags]
        self.totals = [len(p) for p in parts]
        words = [len(next(chunks(pa.array([templates[n]]), PLAIN)).starts) for n in self.names]
        self.wide = [i for i, n in enumerate(words) if n > 1]

    def _best(self, h: np.ndarray) -> tuple[str, float] | None:
        grams = bigrams(h)
        bag, best = None, None
        for name, other, (low, high) in zip(self.names, self.bags, self.bounds):
            if low <= len(grams) <= high:
                bag = bag or Counter(grams.tolist())
                d = dice(bag, other)
                if d >= self.least and (best is None or d > best[1]):
                    best = (name, d)
        return best

    def scan(self, texts: pa.Array) -> list[list[dict]]:
        """Per text, its matches: licence, Dice and the span in code points, in order."""
        out = [[] for _ in range(len(texts))]
        for chunk in chunks(texts, PLAIN):
            h = chunk.word_hashes()
            if not len(h):
                continue
            _, text, starts, ends = chunk.lines()
            first, last = np.searchsorted(chunk.starts, starts), np.searchsorted(chunk.starts, ends)
            pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) > 1 else h[:0]
            known = np.zeros(len(h) + 1, np.int64)
            at = np.minimum(np.searchsorted(self.known, pair), len(self.known) - 1)
            known[1 : len(pair) + 1] = np.cumsum(self.known[at] == pair)
            known[len(pair) + 1 :] = known[len(pair)]
            lone = np.isin(h, self.known)
            units = [[] for _ in range(chunk.n)]
            for text_at, a, z, start, end in self._units(text, first, last, starts, ends):
                n = max(1, z - a - 1)
                inside = known[z - 1] - known[a] if z - a > 1 else int(lone[a])
                if n <= self.most and inside >= self.least / (2 - self.least) * n:
                    best = self._best(h[a:z])
                    if best:
                        base, found = chunk.bounds[text_at], out[chunk.first + text_at]
                        low, high = (int(np.count_nonzero(chunk.points[base:x])) for x in (start, end))
                        if not any(m["license"] == best[0] and low <= m["start"] and m["end"] <= high for m in found):
                            found.append({"license": best[0], "dice": best[1], "start": low, "end": high})
                            same = best[1] * (self.totals[self.names.index(best[0])] + n) / 2
                            units[text_at].append((self.names.index(best[0]), a, z, same))
            hits = np.flatnonzero((self.known[at] == pair) & (chunk.text_of_word[:-1] == chunk.text_of_word[1:])) if len(pair) else np.zeros(0, np.int64)
            for text_at, which, d, a, z in self._windows(hits, at[hits] if len(hits) else hits, chunk.text_of_word, units):
                base = chunk.bounds[text_at]
                low, high = (int(np.count_nonzero(chunk.points[base:x])) for x in (chunk.starts[a], chunk.ends[z - 1]))
                out[chunk.first + text_at].append({"license": self.names[which], "dice": d, "start": low, "end": high})
        for found in out:
            found.sort(key=lambda m: (m["start"], m["end"], m["license"]))
        return out

    def _windows(self, hits, code, text_of_word, units) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, template, Dice, first word, word after) of the windows that add to the units' matches (template, first word, word after, same bigrams)."""
        made: dict[int, list] = {}
        for which in self.wide:
            own = np.flatnonzero(self.counts[which][code] > 0) if len(code) else code
            for d, same, a, z in self._best_windows(hits[own], code[own], text_of_word[hits[own]], which):
                made.setdefault(int(text_of_word[a]), []).append((-same, -d, self.names[which], which, a, z + 2))
        for text_at, windows in made.items():
            taken = list(units[text_at])
            for same, d, _, which, a, z in sorted(windows):
                shared = lambda x, y: min(y, z) - max(x, a)  # noqa: E731, B023
                if not any((w == which and shared(x, y) > 0) or (m >= -same - 1e-6 and 2 * shared(x, y) > min(y - x, z - a)) for w, x, y, m in taken):
                    taken.append((which, a, z, -same))
                    yield text_at, which, -d, a, z

    def _best_windows(self, place: np.ndarray, code: np.ndarray, part: np.ndarray, which: int) -> Iterator[tuple[float, int, int, int]]:
        """(Dice, same bigrams, first, last bigram) of windows without overlap, best first of what is left. place: of the template's bigrams, in order; windows stay within a part."""
        total, count = self.totals[which], self.counts[which]
        longest, least = int(self.bounds[which][1] + 1e-9), self.bounds[which][0] - 1e-9
        while len(place):
            at = place + part * (int(place[-1]) + longest + 1)
            stop = np.searchsorted(at, at + longest)
            starts = np.flatnonzero(stop - np.arange(len(at)) >= least)
            if not len(starts):
                return
            # a bigram counts in a window unless as many of the same as the template has precede it there
            back, seen = np.full(len(at), -1), {}
            for i, c in enumerate(code.tolist()):
                earlier = seen.setdefault(c, [])
                if len(earlier) >= count[c]:
                    back[i] = earlier[-count[c]]
                earlier.append(i)
            best = []
            for some in np.array_split(starts, len(starts) // 256 + 1):
                to = some[:, None] + np.arange(int((stop[some] - some).max()))
                inside = to < stop[some][:, None]
                to = np.minimum(to, len(at) - 1)
                same = np.cumsum(inside & (back[to] < some[:, None]), axis=1)
                d = np.where(inside, 2 * same / (total + at[to] - at[some][:, None] + 1), 0)
                top = d.argmax(axis=1)
                row = np.arange(len(some))
                best += zip((-d[row, top]).tolist(), (-same[row, top]).tolist(), some.tolist(), to[row, top].tolist())
            free, kept = np.ones(len(at), bool), False
            for d, same, i, j in sorted(b for b in best if -b[0] >= self.least):
                if free[i : j + 1].all():
                    free[i : j + 1], kept = False, True
                    yield -d, -same, int(place[i]), int(place[j])
            if not kept:
                return
            # what is left, cut where windows were taken
            part = (part * (len(at) + 1) + np.cumsum(~free))[free]
            part = np.unique(part, return_inverse=True)[1]
            place, code = place[free], code[free]

    def _units(self, text, first, last, starts, ends) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, first word, word after, first byte, byte after) of lines, paragraphs of several lines, and texts of several paragraphs."""
        full = last > first
        yield from zip(text[full].tolist(), first[full].tolist(), last[full].tolist(), starts[full].tolist(), ends[full].tolist())
        change = np.ones(len(text), bool)
        change[1:] = (text[1:] != text[:-1]) | (full[1:] != full[:-1])
        run = np.flatnonzero(change)
        stop = np.append(run[1:], len(text)) - 1
        keep = full[run]
        for i, j in zip(run[keep & (stop > run)].tolist(), stop[keep & (stop > run)].tolist()):
            yield int(text[i]), int(first[i]), int(last[j]), int(starts[i]), int(ends[j])
        paragraphs = np.bincount(text[run[keep]], minlength=int(text[-1]) + 1)
        for t in np.flatnonzero(paragraphs > 1):
            i, j = np.searchsorted(text, t), np.searchsorted(text, t, side="right") - 1
            yield int(t), int(first[i]), int(last[j]), int(starts[i]), int(ends[j])


def matches(text: Column, templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> Column:
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(templates, least)
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for texts in it:
            yield pa.array(scanner.scan(texts), kind)

    return F.arrow_udf(run, KIND)(text)


def find_licenses(docs: DataFrame, text_col: str = "text", as_col: str = "licenses", **how) -> DataFrame:
    """The rows with their licence matches beside them."""
    return docs.withColumn(as_col, matches(F.col(text_col), **how))
