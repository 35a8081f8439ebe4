"""License scan: normalised text against licence templates, by Dice coefficient.

Text is lower-cased and cut into words of letters and digits. What is compared
with the templates are a document's segments: every line, every run of lines
without a blank line between them, the whole text, and every other run of
lines, blank ones or not, so that a licence of several paragraphs is found
inside a longer text. Of these other runs only the best count: one that
overlaps a better match of the same template, or lies within a match that
shares more bigrams, is left out; so is any segment within a match with more
shared bigrams of another licence whose template has the segment's words. A segment's bigrams and
a template's (both as multisets) have the Dice coefficient
2 * |both| / (|segment| + |template|). For a coefficient of ``least`` the sizes
must lie within a factor of (2 - least) / least, so templates are kept by size
and only those within the bounds of a segment are compared; a segment of which
less than least / (2 - least) are bigrams of some template can't match and is
passed over. In lines of which no segment matches, stretches of words as long
as a template are compared with it, so that a notice amid other words is found,
too. A run that begins or ends with a line without such bigrams is worse
than the run without that line, so it isn't compared either.

Long templates (over ``LONG`` bigrams: whole texts of licences) are looked for
first, as stretches of their own length anywhere in the text, lines or not, in
time linear in the text; of stretches that overlap the one with most shared
bigrams counts. What lies in one isn't looked at again, so a licence's own
parts name no other licence.

Templates of one family differ by a number: what follows "version" or a
licence's short name in a template must follow it in the text, too. A bare
reservation of rights within ``NEAR`` lines of a licence is part of its
copyright notice.

Templates are those below and the whole texts in ``license_texts``, or any
others: ``templates_of`` reads a folder of whole licence texts on the driver.

Everything happens where a document lies, without a shuffle; what is broadcast
are the templates, a fixed list. Memory is that of one batch of texts.

Defined results: null, empty and wordless texts match nothing; other columns pass through, whatever their names; single words
have no bigrams; of equal coefficients the template with the smaller name
wins; one row per input row, so repeated rows repeat.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm.common import arrow_map, columns, free
from quillion.session import read

LEAST, LEAST_WINDOW, LONG, NEAR = 0.75, 4, 400, 8
_WORD = re.compile(r"[^\W_]+")

#: Texts of licences and usual notices that refer to them.
TEMPLATES = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT/notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause/conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause/conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD/disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD/notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-or-later/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-or-later/header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "AGPL-3.0-or-later/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "LGPL-2.0-or-later/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-4.0/short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0/short": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Proprietary/short": "All rights reserved.",
    "Proprietary/notice": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
}


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    """Twice the shared bigrams over all, as multisets."""
    total = sum(a.values()) + sum(b.values())
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return 2 * sum(min(n, b[g]) for g, n in a.items() if g in b) / total if total else 0.0


#: Words that a version's number follows.
VERSIONED = frozenset("version v gpl lgpl agpl mpl by sa nc nd attribution sharealike noncommercial".split())


def versions(words: list[str]) -> set[tuple[str, ...]]:
    """Numbers (all digits in a row) with the word before them that tells they are versions."""
    out = set()
    for i, w in enumerate(words[:-1]):
        if w in VERSIONED and words[i + 1].isdigit():
            j = i + 2
            while j < len(words) and words[j].isdigit():
                j += 1
            out.add(("by" if w not in ("version", "v") else "version", *words[i + 1 : j]))
    return out


def whole_texts() -> dict[str, str]:
    """The fixed templates and the whole texts that come with the package; read on the driver."""
    folder = Path(__file__).resolve().parent / "license_texts"
    return TEMPLATES | {f"{f.name}/text": f.read_text("utf-8", "replace") for f in sorted(folder.iterdir())}


def templates_of(folder: str) -> dict[str, str]:
    """The texts of the files in a folder of the driver's, by name; the fixed templates beside them."""
    return TEMPLATES | {f.name: f.read_text("utf-8", "replace") for f in sorted(Path(folder).iterdir()) if f.is_file() and not f.is_symlink()}


class Templates:
    """Templates by size, with the bigrams that any of them holds."""

    def __init__(self, texts: dict[str, str], least: float = LEAST):
        self.least, self.ratio = least, (2 - least) / least
        split = {name: _WORD.findall(t.lower()) for name, t in texts.items()}
        got = [(name, bigrams(w)) for name, w in split.items()]
        sized = sorted((sum(b.values()), name, b) for name, b in got if b)
        self.by_size = [t for t in sized if t[0] <= LONG]
        self.long = [t for t in sized if t[0] > LONG]
        # the first number is the template's own, others may be of what it refers to
        self.needs = {name: v for name, w in split.items() if (v := versions(w if len(w) <= LONG else w[:60]))}
        self.long_known: dict[tuple, list[tuple[int, int]]] = {}
        for k, (_, _, b) in enumerate(self.long):
            for g, many in b.items():
                self.long_known.setdefault(g, []).append((k, many))
        self.known: dict[tuple, list[tuple[int, int]]] = {}
        for k, (_, _, b) in enumerate(self.by_size):
            for g, many in b.items():
                self.known.setdefault(g, []).append((k, many))
        self.largest = self.by_size[-1][0] * self.ratio if self.by_size else 0
        self.compared = 0

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """The template with the largest coefficient, if that is at least ``least``."""
        n = len(words) - 1
        if n < 1 or n > self.largest + 1e-9:
            return None
        grams, top = None, None
        for size, name, b in self.by_size:
            if size * self.ratio < n - 1e-9:
                continue
            if size > n * self.ratio + 1e-9:
                break
            grams = bigrams(words) if grams is None else grams
            self.compared += 1
            d = dice(grams, b)
            if d >= self.least and (top is None or (-d, name) < (-top[0], top[1])) and self.fits(name, words):
                top = (d, name)
        return top

    def fits(self, name: str, words: list[str]) -> bool:
        """Do the words hold the template's versions?"""
        return name not in self.needs or self.needs[name] <= versions(words)

    def runs(self, words: list[str], ends: list[int], hits: list[int], known: set[tuple[int, int]]) -> list[tuple[int, int, float, str]]:
        """Matches of runs of two lines or more, without the segments ``known``; as ``scan`` has them."""
        share = self.least / (2 - self.least)
        end, before = np.array(ends), np.zeros(len(words) + 1, np.int64)
        before[np.array(hits) + 1] = 1
        before = before.cumsum()
        # a first line in which a known bigram begins, a last line in which one ends
        first = np.flatnonzero(before[end[1:]] > before[end[:-1]])
        last = np.flatnonzero(before[np.maximum(end[1:] - 1, 0)] > before[np.maximum(end[:-1] - 1, 0)]) + 1
        if not len(first) or not len(last):
            return []
        # known bigrams less the share that the run must have: a run matches only if that grows
        at_first, at_last = before[end[first]] - share * end[first], before[end[last] - 1] - share * (end[last] - 1)
        best_after = np.append(np.maximum.accumulate(at_last[::-1])[::-1], -np.inf)
        low = np.searchsorted(last, first + 2)
        out = []
        for k in np.flatnonzero(best_after[low] >= at_first - 1e-9).tolist():
            a, begin = int(first[k]), ends[first[k]]
            high = np.searchsorted(end[last], begin + 1 + self.largest + 1e-9, "right")
            stops = last[low[k] : high][at_last[low[k] : high] >= at_first[k] - 1e-9].tolist()
            seen: Counter = Counter()
            shared, at = [0] * len(self.by_size), begin
            for b in stops:
                for i in range(at, ends[b] - 1):
                    g = (words[i], words[i + 1])
                    if held := self.known.get(g):
                        seen[g] += 1
                        for t, many in held:
                            shared[t] += seen[g] <= many
                at, n = max(at, ends[b] - 1), ends[b] - begin - 1
                if (a, b) not in known:
                    near = sorted((-2 * x / (n + size), name) for x, (size, name, _) in zip(shared, self.by_size, strict=True) if 2 * x >= self.least * (n + size))
                    if fit := next((m for m in near if self.fits(m[1], words[begin : ends[b]])), None):
                        out.append((a, b, -fit[0], fit[1]))
        return out

    def stretches(self, words: list[str]) -> list[tuple[int, int, float, str]]:
        """(first word, word after the last, coefficient, template) of long templates' matches, none overlapping another."""
        hits = [i for i, g in enumerate(zip(words, words[1:], strict=False)) if g in self.long_known]
        if not self.long or len(hits) < self.least * self.long[0][0]:
            return []
        size, out = {name: n for n, name, _ in self.long}, []
        found = [m for m in self.windows(words, hits, self.long, self.long_known) if self.fits(m[3], words[m[0] : m[1]])]
        for m in sorted(found, key=lambda m: (-m[2] * size[m[3]], m)):
            if not any(m[0] < o[1] and o[0] < m[1] for o in out):
                out.append(m)
        return sorted(out)

    def windows(self, words: list[str], hits: list[int], templates: list | None = None, known: dict | None = None) -> list[tuple[int, int, float, str]]:
        """(first word, word after the last, coefficient, template) of stretches as long as a template that match it.

        Of stretches that overlap the one with the largest coefficient counts,
        then the longer. Templates of fewer than ``LEAST_WINDOW`` bigrams are too
        short to be looked for inside lines.
        """
        templates, known = templates or self.by_size, known or self.known
        places: dict[int, list[int]] = {}
        for i in hits:
            for t, _ in known[words[i], words[i + 1]]:
                places.setdefault(t, []).append(i)
        found = []
        for t, at in places.items():
            size, name, grams = templates[t]
            if size < LEAST_WINDOW or len(at) < self.least * size:
                continue
            seen: Counter = Counter()
            shared = left = 0
            for p in at:
                g = (words[p], words[p + 1])
                seen[g] += 1
                shared += seen[g] <= grams[g]
                while p - at[left] >= size:
                    g = (words[at[left]], words[at[left] + 1])
                    shared -= seen[g] <= grams[g]
                    seen[g] -= 1
                    left += 1
                if shared >= self.least * size - 1e-9:
                    found.append((-shared / size, -size, at[left], name, p + 2))
        taken, out = bytearray(len(words)), []
        for d, _, start, name, end in sorted(found):
            if not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                out.append((start, end, -d, name))
        return out

    def scan(self, text: str | None) -> list[tuple[int, int, float, str]]:
        """(first line, line after the last, coefficient, template) of the matching segments, in order.

        Lines come first, then the runs of lines without a blank one, then the
        whole text, then other runs, then what matches inside lines of which no
        segment does, then long templates; a segment of the same lines as one
        before it isn't repeated.
        """
        return [m[:4] for m in self.matches(text)]

    def matches(self, text: str | None) -> list[tuple[int, int, float, str, int]]:
        """As ``scan`` has them, with the number of shared bigrams."""
        words, ends, lines = self._words(text)
        size = {name: n for n, name, _ in self.by_size + self.long}
        spans = self.stretches(words)
        whole = [(bisect_right(ends, start) - 1, bisect_left(ends, end), d, name, round(d * size[name])) for start, end, d, name in spans]
        hits = [i for i, g in enumerate(zip(words, words[1:], strict=False)) if g in self.known]
        for start, end, _, _ in spans:  # what lies in a long match names no other
            hits = hits[: bisect_left(hits, start)] + hits[bisect_left(hits, end - 1) :]
        found = [(*m, round(m[2] * (ends[m[1]] - ends[m[0]] - 1 + size[m[3]]) / 2)) for m in self._segments(lines, words, ends, hits)] if hits else []
        held = bytearray(len(ends) - 1)
        for a, b, *_ in found:
            held[a:b] = b"\1" * (b - a)
        inside = []
        for start, end, d, name in self.windows(words, hits) if hits else []:
            a, b = bisect_right(ends, start) - 1, bisect_left(ends, end)
            if not any(held[a:b]) and self.fits(name, words[start : end + 2]):
                inside.append((a, b, d, name, round(d * size[name])))
        out = found + sorted(dict.fromkeys(inside)) + whole
        granted = [m for m in out if not m[3].startswith("Proprietary/")]
        return [m for m in out if m[3] != "Proprietary/short" or not any(m[0] < g[1] + NEAR and g[0] - NEAR < m[1] for g in granted)]

    @staticmethod
    def _words(text: str | None) -> tuple[list[str], list[int], list[str]]:
        """Words, where each line's begin, and the lines."""
        lines = text.lower().split("\n") if text else []
        words: list[str] = []
        ends = [0]
        for line in lines:
            words += _WORD.findall(line)
            ends.append(len(words))
        return words, ends, lines

    def _segments(self, lines: list[str], words: list[str], ends: list[int], hits: list[int]) -> list[tuple[int, int, float, str]]:
        """The matches of whole lines and their runs; ``hits`` are the places of known bigrams."""
        segments = [(i, i + 1) for i in range(len(lines))]
        start = 0
        for i in range(len(lines) + 1):
            if i == len(lines) or not lines[i].strip():
                segments += [(start, i)] if i > start else []
                start = i + 1
        out = []
        for a, b in dict.fromkeys([*segments, (0, len(lines))]):
            first, end = ends[a], ends[b]
            # a template shares at most the known bigrams, and has at least n / ratio
            if bisect_left(hits, end - 1) - bisect_left(hits, first) >= self.least * (end - first - 1) / (2 - self.least) - 1e-9 and (hit := self.best(words[first:end])) is not None:
                out.append((a, b, *hit))
        if len(lines) < 3:
            return out
        fixed = set(segments) | {(0, len(lines))}
        size = {name: n for n, name, _ in self.by_size}
        kept: list[tuple] = []
        # the best first; what was compared before stays in any case
        for m in sorted(out + self.runs(words, ends, hits, fixed), key=lambda m: (-m[2], m[:2] not in fixed, -(m[1] - m[0]), m)):
            if m[:2] in fixed or not any(m[3] == o[3] and m[0] < o[1] and o[0] < m[1] for o in kept):
                kept.append(m)
        grams = {m: m[2] * (ends[m[1]] - ends[m[0]] - 1 + size[m[3]]) / 2 for m in kept}
        over = {m: [o for o in kept if o[0] <= m[0] and m[1] <= o[1] and grams[o] > grams[m] + 1e-9] for m in kept}
        held = {name: b for _, name, b in self.by_size}

        def part(m: tuple, o: tuple) -> bool:
            """Are the words of m those of another licence's template?"""
            own = bigrams(words[ends[m[0]] : ends[m[1]]])
            return o[3].split("/")[0] != m[3].split("/")[0] and sum((own & held[o[3]]).values()) >= self.least * sum(own.values())

        parts = {m for m in out if any(part(m, o) for o in over[m])}
        return [m for m in out if m not in parts] + sorted(m for m in kept if m[:2] not in fixed and not over[m])


MATCH = T.ArrayType(T.StructType([T.StructField("first_line", T.LongType()), T.StructField("end_line", T.LongType()), T.StructField("dice", T.DoubleType()), T.StructField("template", T.StringType()), T.StructField("shared", T.LongType())]))


def scan(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) and as the last one _matches, the segments that match a template (underscores behind the name if it is taken)."""
    keep = docs.columns if keep is None else keep
    df, name = columns(docs, [*keep, text_col]), free("_matches", keep)
    texts = whole_texts() if templates is None else templates
    state: dict = {}

    def fn(b: pa.RecordBatch) -> dict:
        if "t" not in state:
            state["t"] = Templates(texts, least)
        found = [[{"first_line": a, "end_line": e, "dice": d, "template": n, "shared": k} for a, e, d, n, k in state["t"].matches(t)] for t in b.column(text_col).to_pylist()]
        return {c: b.column(c) for c in keep} | {name: found}

    return arrow_map(df, fn, T.StructType([*[df.schema[c] for c in keep], T.StructField(name, MATCH)]))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many segments match, the match with most shared bigrams and the licences found."""
    m = scan(read(spark, sf_dir, "documents"), keep=["doc_id"])
    order = F.expr("array_sort(_matches, (x, y) -> case when x.shared > y.shared then -1 when x.shared < y.shared then 1 when x.dice > y.dice then -1 when x.dice < y.dice then 1 when x.template < y.template then -1 when x.template > y.template then 1 else cast(sign(x.first_line - y.first_line) as int) end)")
    top = F.try_element_at(order, F.lit(1))
    names = F.array_sort(F.array_distinct(F.transform("_matches", lambda x: F.substring_index(x["template"], "/", 1))))
    return m.select("doc_id", F.size("_matches").cast("long").alias("n_matches"), top["template"].alias("template"), top["dice"].alias("dice"), F.array_join(names, ",").alias("licenses"))
