"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Texts and templates are read as lower-cased runs of ASCII letters and digits with single blanks between.
Of the hashes of all `GRAM`-byte strings, winnowing keeps the smallest in every `WINDOW` neighbouring
ones, so any shared run of GRAM + WINDOW - 1 bytes shares a kept hash. The templates' kept hashes form a
small inverted index (hash -> template, word), which goes with the code; a text's kept hashes that hit it
are candidates, one for each template and diagonal. From each, template words and text words are aligned
both ways in a band around the diagonal (match +2, unlike words -1, gaps -1, ends of both free); a row is
reported when the matched words cover at least `coverage` of the template. Every candidate is aligned
through its own place, so neighbouring copies are matches of their own. Of overlapping matches the one
of the higher score stays, then that of more matched words, the earlier template, the earlier place.

A copy is missed only if no GRAM + WINDOW - 1 bytes in a row survive in it, or if words inserted or left
out shift it by more than `BAND`. Templates of fewer bytes than such a run are refused.

Result: doc_id, license, begin and end (code points of the whole text), matched and template_words,
coverage. Nulls and texts without a match give no row; a null doc_id is kept null; repeated rows repeat
their matches. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import roomy, small_batches
from .textkit import BYTE_VALUES, LOWER, Spans, U, slices

GRAM, WINDOW, BAND = 12, 6, 8

# Wording of public license notices.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "Apache-2.0-notice": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-SA-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
_WORD = re.compile(rb"[a-z0-9]+")
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(97, 123)]] = True


def normal(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that count, and their places; the first other byte after a word is a blank, also at a text's first byte."""
    low = LOWER[data]
    plain = _PLAIN[low]
    after = np.zeros(len(data), bool)
    after[1:] = plain[:-1]
    keep = plain | after | edge
    return np.where(plain, low, np.uint8(32))[keep], np.flatnonzero(keep)


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the smallest hash of each window, the last of equals; all windows of a short sequence count as one."""
    n = len(hashes)
    if n <= WINDOW:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes[::-1], WINDOW)
    return np.unique(n - 1 - (np.arange(len(windows)) + windows.argmin(1)))


def index_of(templates: dict[str, str]) -> tuple[list[str], list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """(names, words, sorted kept hashes, template of each, word at which each starts)."""
    names, words, hashes, owner, place = list(templates), [], [], [], []
    for i, text in enumerate(templates.values()):
        own = _WORD.findall(text.lower().encode())
        words.append(own)
        body = np.frombuffer(b" ".join(own), np.uint8)
        h = Spans(BYTE_VALUES[body]).windows(GRAM)
        if len(h) < WINDOW:
            raise ValueError(f"template {names[i]!r} has fewer than {GRAM + WINDOW - 1} bytes")
        kept = winnow(h)
        starts = np.cumsum([0, *(len(w) + 1 for w in own)])
        hashes.append(h[kept])
        owner.append(np.full(len(kept), i))
        place.append(np.searchsorted(starts, kept, side="right") - 1 + (body[kept] == 32))
    hashes, owner, place = (np.concatenate([np.empty(0, kind), *x]) for x, kind in ((hashes, U), (owner, np.int64), (place, np.int64)))
    order = np.argsort(hashes, kind="stable")
    return names, words, hashes[order], owner[order], place[order]


def extend(template: list[bytes], text: list[bytes], band: int = BAND) -> tuple[int, int, int]:
    """Best alignment of two sequences from their first words on, its end free: (score, matched, words of text up to the last match)."""
    best = (0, 0, 0)  # score, matched, less the end: the shorter of equals
    row = {j: (-j, 0, 0) for j in range(min(len(text), band) + 1)}
    for i, word in enumerate(template):
        new: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + 1 - band), min(len(text), i + 1 + band) + 1):
            cells = []
            if j and j - 1 in row:
                score, matched, end = row[j - 1]
                cells.append((score + 2, matched + 1, -j) if word == text[j - 1] else (score - 1, matched, end))
            for near in (row.get(j), new.get(j - 1)):
                if near is not None:
                    cells.append((near[0] - 1, near[1], near[2]))
            if cells:
                new[j] = max(cells)
        if not new:
            break
        best, row = max(best, max(new.values())), new
    return best[0], best[1], -best[2]


def align(template: list[bytes], text: list[bytes], word: int, at: int, band: int = BAND) -> tuple[int, int, int, int]:
    """Best alignment through template word `word` and text word `at`: (score, matched, first, past the last text word)."""
    size = len(template) + band
    after = extend(template[word:], text[at : at + size], band)
    before = extend(template[:word][::-1], text[max(0, at - size) : at][::-1], band)
    return after[0] + before[0], after[1] + before[1], at - before[2], at + after[2]


def apart(found: list[tuple]) -> list[tuple]:
    """Of overlapping (score, matched, template, first, past) those that stay, by place."""
    begins: list[tuple] = []
    for row in sorted(set(found), key=lambda r: (-r[0], -r[1], *r[2:])):
        span = (row[3], row[4], row)
        k = bisect(begins, span)
        if (k == 0 or begins[k - 1][1] <= row[3]) and (k == len(begins) or begins[k][0] >= row[4]):
            insort(begins, span)
    return [row for _, _, row in begins]


def matches(text: bytes, places: list[tuple[int, int, int]], names, words, coverage: float) -> list[tuple]:
    """Non-overlapping matches of a text from candidate (template, template word, byte) places."""
    spans = [m.span() for m in _WORD.finditer(text.lower())]
    tokens = [text[a:b].lower() for a, b in spans]
    starts = [a for a, _ in spans]
    seen, found = set(), []
    for t, word, byte in places:
        at = bisect(starts, byte) - 1
        if (t, at - word) in seen:
            continue
        seen.add((t, at - word))
        score, matched, first, past = align(words[t], tokens, word, at)
        if matched and matched / len(words[t]) >= coverage:
            found.append((score, matched, t, first, past))
    if not found:
        return []
    point = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(names[t], int(point[spans[a][0]]), int(point[spans[z - 1][1]]), m, len(words[t]), m / len(words[t])) for _, m, t, a, z in apart(found)]


def _scan(index, coverage: float):
    names, words, hashes, owner, place = index

    def run(batches):
        for b in batches:
            doc, rows = b.column(0), []
            for i, j, data, offsets in slices(b.column(1)):
                if not len(data):
                    continue
                edge = np.zeros(len(data) + 1, bool)
                edge[offsets] = True
                body, at = normal(data, edge[:-1])
                h = Spans(BYTE_VALUES[body]).windows(GRAM)
                own = np.searchsorted(offsets, at, side="right")
                h[own[: len(h)] != own[GRAM - 1 :]] = ~U(0)  # reaches into the next text: never kept where others are
                kept = winnow(h)
                kept = kept[own[kept] == own[kept + GRAM - 1]]
                low = np.searchsorted(hashes, h[kept])
                high = np.searchsorted(hashes, h[kept], side="right")
                by_row: dict[int, list] = {}
                for k in np.flatnonzero(low < high).tolist():
                    row, blank = int(own[kept[k]]) - 1, int(body[kept[k]] == 32)
                    byte = int(at[kept[k] + blank] - offsets[row])
                    by_row.setdefault(row, []).extend((int(owner[n]), int(place[n]), byte) for n in range(low[k], high[k]))
                for row, places in by_row.items():
                    text = data[offsets[row] : offsets[row + 1]].tobytes()
                    rows += [(doc[i + row].as_py(), *m) for m in matches(text, places, names, words, coverage)]
            if rows:
                kinds = (pa.int64(), pa.string(), *(pa.int64(),) * 4, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "license", "begin", "end", "matched", "template_words", "coverage"])

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """(doc_id, license, begin, end, matched, template_words, coverage), a row for each match; see the module."""
    small_batches(docs.sparkSession)
    index = index_of(TEMPLATES if templates is None else templates)
    return docs.select("doc_id", "text").mapInArrow(roomy(_scan(index, coverage)), "doc_id long, license string, begin long, end long, matched long, template_words long, coverage double")
