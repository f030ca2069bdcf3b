"""License notices: winnowed fingerprints of templates find where a text may hold one, a banded alignment decides."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm import hashing
from lexivec.llm.common import text_of
from lexivec.llm.hashing import U64

_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# Whole licence texts, without their copyright lines.
FULL_TEXTS: tuple[tuple[str, str], ...] = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    ("BSD-2-Clause", f"{_CONDITIONS}\n{_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_CONDITIONS}\n{_CLAUSE}\n{_DISCLAIMER}"),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "GPL-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    ),
)

# The wording of widely used notices, by SPDX identifier where there is one.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "All rights reserved."),
)

#: A notice of the first name is one of the second if that one's own clause comes before the next notice of the first.
WITH_CLAUSE = {"BSD-2-Clause": "BSD-3-Clause"}
TEMPLATES = NOTICES + FULL_TEXTS
#: Words in a fingerprinted gram, and grams in a winnowing window: every shared run of GRAM + WINDOW - 1 words is found,
#: the shortest that a template matched to COVERAGE leaves for sure unless it is very short.
GRAM, WINDOW = 3, 2
#: Words in the grams of the very short templates, which are all looked up.
SHORT_GRAM = 2
#: The least part of a template's words that an alignment must match.
COVERAGE = 0.8
MATCH, OTHER, GAP = 2, -1, -1


class Words:
    """Word hashes of a text with their places in bytes: lower-cased runs of ASCII letters and digits and of bytes over 127."""

    def __init__(self) -> None:
        self.hasher = hashing.RangeHasher(20240504, fold=True)
        self.places = np.random.default_rng(20240506).integers(1, 1 << 63, GRAM, dtype=U64) | U64(1)
        self.inside = np.zeros(256, bool)
        self.inside[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, starts, ends)."""
        b = np.frombuffer(data, np.uint8)
        starts, ends = hashing.runs(b, self.inside)
        return self.hasher(b, starts, ends), starts, ends

    def grams(self, hashes: np.ndarray, n: int = GRAM) -> np.ndarray:
        return hashing.grams(hashes, self.places[:n])


def winnow(grams: np.ndarray) -> np.ndarray:
    """Places of the grams that are smallest in some window of WINDOW, the last of equal ones."""
    if len(grams) <= WINDOW:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams[::-1], WINDOW)
    return np.unique(len(grams) - 1 - (np.arange(len(windows)) + windows.argmin(axis=1)))


def align(template: list[int], text: list[int], shift: int, band: int) -> tuple[int, int, int, int]:
    """(score, matched words, start, end) of the best local alignment whose cells i, j keep |j - i - shift| <= band."""
    width = 2 * band + 1
    none = (0, 0, -1)  # score, matched, start in text
    before, best = [none] * (width + 2), (0, 0, 0, 0)
    for i, word in enumerate(template):
        row = [none] * (width + 2)
        for d in range(width):
            j = i + shift - band + d
            if not 0 <= j < len(text):
                continue
            same = text[j] == word
            score, matched, start = before[d + 1]
            options = [(score + (MATCH if same else OTHER), matched + same, j if start < 0 else start)]
            for s, m, at in (before[d + 2], row[d]):  # a template word skipped, a text word skipped
                options.append((s + GAP, m, at))
            top = max(options)
            if top[0] > 0:
                row[d + 1] = top
                if top[:2] > best[:2]:
                    best = (top[0], top[1], top[2], j + 1)
        before = row
    return best


def sure_run(n: int, coverage: float) -> int:
    """Words of the longest run that is left for sure when a template of n words is matched as far as the coverage asks."""
    least = next((m for m in range(1, n + 1) if m >= coverage * n), n)
    return math.ceil(least / (n - least + 1))


def chosen(found: list[tuple]) -> list[tuple[int, int, int, int, float]]:
    """(template, start, end, matched, coverage) of those of (-score, -coverage, template, start, end, matched) that overlap
    no better one, by start."""
    taken: list[tuple[int, int]] = []
    out = []
    for _, cover, k, a, b, matched in sorted(found):
        at = bisect_left(taken, (a, b))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
            taken.insert(at, (a, b))
            out.append((k, a, b, matched, -cover))
    return out


class Index:
    """Inverted index from grams to their places in templates."""

    def __init__(self, grams: list[tuple[int, int, int]]):
        """grams: (gram, template, place)."""
        self.places: dict[int, list[tuple[int, int]]] = {}
        for g, k, q in grams:
            self.places.setdefault(g, []).append((k, q))
        self.known = np.array(sorted(self.places), U64)

    def hits(self, grams: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in the text, template, place in the template) for the grams at the places `of`."""
        if not len(self.known) or not len(of):
            return
        at = np.minimum(np.searchsorted(self.known, grams[of]), len(self.known) - 1)
        for p in of[self.known[at] == grams[of]].tolist():
            for k, q in self.places[int(grams[p])]:
                yield p, k, q


class Scanner:
    """Matches of templates in a text; holds the inverted index from fingerprints to places in templates."""

    def __init__(self, templates: tuple[tuple[str, str], ...], coverage: float):
        self.words, self.coverage = Words(), coverage
        self.names = [n for n, _ in templates]
        self.templates = [self.words(t.encode())[0] for _, t in templates]
        self.kinds = [np.unique(t) for t in self.templates]
        # Templates and texts are winnowed alike, so that each run they share leaves a common fingerprint. Templates of
        # which changed words may leave no run that long have every pair of words looked up.
        short, long = [], []
        for k, t in enumerate(self.templates):
            if sure_run(len(t), coverage) < GRAM + WINDOW - 1:
                short += [(g, k, q) for q, g in enumerate(self.words.grams(t, SHORT_GRAM).tolist())]
            else:
                grams = self.words.grams(t)
                long += [(int(grams[q]), k, q) for q in winnow(grams).tolist()]
        self.short, self.long = Index(short), Index(long)

    def regions(self, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(template, shift) of each place of a text where a template may stand."""
        pairs, grams = self.words.grams(hashes, SHORT_GRAM), self.words.grams(hashes)
        live: dict[int, list[int]] = {}
        for index, g, of in ((self.short, pairs, np.arange(len(pairs))), (self.long, grams, winnow(grams))):
            for p, k, q in index.hits(g, of):
                n, shift = len(self.templates[k]), p - q
                band = max(2, n // 8)
                mine = live[k] = [s for s in live.get(k, []) if p <= s + n + band]
                if all(abs(shift - s) > band for s in mine):
                    mine.append(shift)
                    yield k, shift

    def matched(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(score, matched, template, start, end), in words, of each alignment that reaches the coverage."""
        for k, shift in self.regions(hashes):
            t = self.templates[k]
            band, n = max(2, len(t) // 8), len(t)
            low = max(0, shift - band)
            part = hashes[low : shift + n + band + 1]
            # Words that the place does not have cannot be matched.
            if np.isin(t, part).sum() < self.coverage * n or np.isin(part, self.kinds[k]).sum() < self.coverage * n:
                continue
            score, matched, a, b = align(t.tolist(), part.tolist(), shift - low, band)
            if matched >= self.coverage * n and matched:
                yield score, matched, k, low + a, low + b

    def scan(self, text: str) -> list[tuple[str, int, int, int, int, float]]:
        """(license, start, end, matched, words of the template, coverage) in code points; of overlapping matches the one
        with the best alignment, then the best coverage, then the first template."""
        data = text.encode("utf-8", "surrogatepass")
        hashes, starts, ends = self.words(data)
        out = chosen([(-score, -matched / len(self.templates[k]), k, a, b, matched) for score, matched, k, a, b in self.matched(hashes)])
        out.sort(key=lambda m: m[1])
        later: set[str] = set()
        names = []
        for k, *_ in reversed(out):
            name = self.names[k]
            more = WITH_CLAUSE.get(name)
            names.append(more if more in later else name)
            later.add(name)
            later.discard(more)
        rows, byte, point = [], 0, 0
        for (k, a, b, matched, cover), name in zip(out, reversed(names), strict=True):
            i, j = int(starts[a]), int(ends[b - 1])
            point += len(data[byte:i].decode("utf-8", "surrogatepass"))
            length = len(data[i:j].decode("utf-8", "surrogatepass"))
            rows.append((name, point, point + length, matched, len(self.templates[k]), cover))
            byte, point = j, point + length
        return rows


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, start, end, matched, template_words, coverage) of each notice in docs (doc_id, text).

    start and end are code points of the text. A null or empty text has none; repeated rows each have theirs. Templates
    are a parameter of the job and go to the tasks with the code."""
    columns = ["license", "start", "end", "matched", "template_words", "coverage"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, coverage)
        for pdf in batches:
            rows = [(i, *m) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for m in scanner.scan(t)]
            yield pd.DataFrame(rows, columns=["doc_id", *columns])

    schema = "doc_id string, license string, start bigint, end bigint, matched int, template_words int, coverage double"
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text")).mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
