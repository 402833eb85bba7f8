"""License scans by patience alignment.

Each template is aligned to the stretches of a text that can hold it: words
unique to both sides are anchors, the longest increasing run of anchors is taken,
and the gaps between them are aligned in the same way; a gap without anchors is
closed by a longest common subsequence.  Coverage is the share of the template's words
that are aligned.

What is aligned must lie together: of all words of the text from the first aligned one to
the last, at least ``MIN_DENSITY`` are aligned.  Every gap is decided by what it costs: the
longest run of aligned words that is dense counts, so sixty words put into a long license
are bridged, and the words of a short one scattered over a text are no license.

A run of n aligned words spans n / MIN_DENSITY words at most, so it lies in a window
around any of its words.  Windows stand where one of as many template words occurs, the
rarest in the text first, as cannot all be missing at the coverage; windows of three
widths, the tightest first, each overlapping the next by all that a run can span, so their
number, and the time, grow with the text and not with how often its words recur.  The run
that is found is aligned once more with what stands next to it.  A text that lacks too
many of a template's words, or has them in another order, cannot reach the coverage and is
passed over, which loses nothing.

Defined results: a null, empty or wordless text has no license and coverage 0;
of several templates the best covered wins, then the longest, then the first listed, and
``licenses`` lists all that reach the coverage; repeated rows
are scanned one by one; extra columns pass through, those named like a result
are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestar.llm.shared import bounded_batches

#: Public license notices and texts, without the lines that name a holder.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": "Released under the MIT License.",
    "MIT-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
MIN_COVERAGE = 0.8
#: The least share of aligned words in the span from the first to the last.
MIN_DENSITY = 0.5
_FIELDS, _KINDS = ("license", "coverage", "first_word", "after_word"), (pa.string(), pa.float64(), pa.int32(), pa.int32())
_WORD = re.compile(r"\w+(?:[.'-]\w+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (in order of their first place) whose second places rise."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back[k] = at[p - 1] if p else -1
        tails[p : p + 1] = [j]
        at[p : p + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _exact(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence: one bit per word of ``b``, one row of bits per word of ``a`` that ``b`` has."""
    masks: dict[str, int] = {}
    for j, w in enumerate(b):
        masks[w] = masks.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    at = [i for i, w in enumerate(a) if w in masks]
    rows = [full]
    for i in at:
        both = rows[-1] & masks[a[i]]
        rows.append((rows[-1] + both | rows[-1] - both) & full)
    # A bit is clear where the subsequence grows with that word of ``b``; it is matched in the first row that clears it.
    out, i, j = [], len(at), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((at[i], j))
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment: pairs of places of equal words, rising on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        left, right = Counter(a[i:i_end]), Counter(b[j:j_end])
        places = {w: k for k, w in enumerate(b[j:j_end], j) if right[w] == 1}
        anchors = _rising([(k, places[w]) for k, w in enumerate(a[i:i_end], i) if left[w] == 1 and w in places])
        if not anchors:
            out += [(i + x, j + y) for x, y in _exact(a[i:i_end], b[j:j_end])]
            continue
        out += anchors
        edge = (i - 1, j - 1)
        for x, y in [*anchors, (i_end, j_end)]:
            todo.append((edge[0] + 1, x, edge[1] + 1, y))
            edge = (x, y)
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words_of(text)
        self.counts = Counter(self.words)
        self.masks: dict[str, int] = {}
        for k, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << k
        self.needed = sorted(self.counts, key=lambda w: (-len(w), w))  # long words are the least likely in other texts

    def may_cover(self, lowered: str, least: float) -> bool:
        """False only where the text lacks so many words that the coverage is out of reach."""
        spare = len(self.words) - math.ceil(least * len(self.words) - 1e-9)
        for w in self.needed:
            if w not in lowered:
                spare -= self.counts[w]
                if spare < 0:
                    return False
        return True

    def most(self, words: list[str]) -> int:
        """The length of the longest common subsequence of a text and the template: no alignment holds more words."""
        full, left = (1 << len(self.words)) - 1, (1 << len(self.words)) - 1
        for w in words:
            if m := self.masks.get(w):
                both = left & m
                left = (left + both | left - both) & full
        return len(self.words) - left.bit_count()

    def densest(self, pairs: list[tuple[int, int]], floor: int = 0) -> tuple[int, int, int]:
        """How many pairs (over ``floor``) the longest dense run holds, and its first and last place in the text."""
        for n in range(len(pairs), floor, -1):
            for k in range(len(pairs) - n + 1):
                if n >= MIN_DENSITY * (pairs[k + n - 1][0] - pairs[k][0] + 1):
                    return n, pairs[k][0], pairs[k + n - 1][0]
        return floor, 0, 0

    def best(self, words: list[str], places: dict[str, list[int]], least: float) -> tuple[float, int, int]:
        """Coverage and the word span of the longest dense run of aligned words, the tightest windows first."""
        size, top, found = len(self.words), self.most(words), (0, 0, 0)
        if not top or top / size < least:
            return 0.0, 0, 0
        # An alignment that reaches the coverage holds one of any words that stand for more places than may be missing.
        spare, some = size - math.ceil(least * size - 1e-9), []
        for w in sorted(self.counts, key=lambda w: (len(places.get(w, ())), w)):
            if spare < 0:
                break
            spare -= self.counts[w]
            some.append(w)
        at = sorted({x for w in some for x in places.get(w, ())})
        for reach in (size + size // 4 + 2, math.ceil(1.5 * size) + 2, math.ceil(size / MIN_DENSITY)):
            stride, seen = max(16, reach // 4), -1
            for x in at:
                if x // stride == seen:
                    continue
                seen = x // stride
                a, b = max(0, seen * stride - reach), min(len(words), (seen + 1) * stride + reach)
                floor = max(found[0], math.ceil(least * size - 1e-9) - 1)
                n, first, last = self.densest([(a + i, j) for i, j in align(words[a:b], self.words)], floor)
                if n > floor:
                    found = self.widened(words, n, first, last)
                if found[0] == top:
                    break
            if found[0] == top:
                break
        return (found[0] / size, found[1], found[2] + 1) if found[0] else (0.0, 0, 0)

    def widened(self, words: list[str], n: int, first: int, last: int) -> tuple[int, int, int]:
        """The run aligned anew with the words next to it: its ends may have been matched to words further off."""
        while True:
            span = math.ceil(len(self.words) / MIN_DENSITY)
            a, b = max(0, last + 1 - span), min(len(words), first + span)
            again = self.densest([(a + i, j) for i, j in align(words[a:b], self.words)], n)
            if again[0] <= n:
                return n, first, last
            n, first, last = again


def scan(text: str | None, templates: list[Template], least: float = MIN_COVERAGE) -> tuple[str | None, float, int | None, int | None, list[dict]]:
    """License, coverage and word span of the best covered template, and all that reach ``least``; (None, 0.0, None, None, []) if none does."""
    out, size, every = (None, 0.0, None, None), 0, []
    lowered = text.lower() if text else ""
    some = [t for t in templates if t.may_cover(lowered, least)] if lowered else []
    if some:
        words = words_of(lowered)
        wanted = set().union(*(t.counts for t in some))
        places: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            if w in wanted:
                places.setdefault(w, []).append(k)
        for t in some:
            coverage, a, b = t.best(words, places, least)
            if coverage >= least and coverage > 0:
                every.append(dict(zip(_FIELDS, (t.name, coverage, a, b), strict=True)))
                if (coverage, len(t.words)) > (out[1], size):
                    out, size = (t.name, coverage, a, b), len(t.words)
    return *out, every


_RESULT = "license string, coverage double, first_word int, after_word int"
_EVERY = pa.list_(pa.struct([(f, k) for f, k in zip(_FIELDS, _KINDS, strict=True)]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = MIN_COVERAGE) -> DataFrame:
    """``docs`` with license, coverage, first_word and after_word (places among the words of the text), and the same of every license found, in the templates' order."""
    bounded_batches(docs.sparkSession)
    held = docs.drop(*_FIELDS, "licenses")
    schema = T.StructType([*held.schema.fields, *T._parse_datatype_string(f"{_RESULT}, licenses array<struct<{_RESULT.replace(' ', ': ').replace(',:', ',')}>>").fields])

    def run(batches):
        ready = [Template(k, v) for k, v in templates.items()]
        for batch in batches:
            found = [scan(t, ready, least) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            cols = [list(c) for c in zip(*found, strict=True)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, (*_KINDS, _EVERY), strict=True))], schema.names)

    return held.mapInArrow(run, schema)
