"""Operator 6, licence scan: texts against licence templates by Dice coefficient
over word bigrams.

A window is a run of a text's words, over lines and sentences. For each template
of whose bigrams the whole text holds enough, windows begin and end at bigrams of
the template, as one more foreign bigram at an edge only lowers the coefficient.
They run over foreign words until the coefficient can't be reached: ``t`` allows
at most (2 - 2t) / t of the template's size in foreign bigrams, and needs t / (2 - t)
of its own. Of overlapping windows with 0.8 or more the one is kept that shares most
bigrams with its template after taking off those by which they differ, so that a
short notice inside an altered full text doesn't stand in for it; then the longer,
then the first. A match is given by
the pieces (sentences and lines) from that of its first word to that of its last.

Templates are a table of the caller's (name, text), bounded by ``MAX_TEMPLATES``
words in all, or the built-in ones: notices and headers as listed here, and the
full texts of ``license_texts``. Texts are scanned whole.

Defined results: null and empty texts and an empty template table match
nothing; repeated rows each give their matches; of equal coefficients the
template whose name sorts first.
"""

from __future__ import annotations

import bisect
import heapq
import re
from functools import lru_cache
from importlib import resources
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DICE = 0.8
NONE = -(1 << 62)
MAX_TEMPLATES = 2_000_000  # words of all templates together; they go to every task

#: Public licence notices, headers and short texts.
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. ")
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_HEADERS = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                  "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
                  "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
                  "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                  "limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
           "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
           "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
           "in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
           "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
           "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
           "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
           "DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
           "that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
               "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
               "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
               "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
               "available at https://www.eclipse.org/legal/epl-2.0/",
    "EPL-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public "
               "License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
                "that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY,
    "BSD-2-Clause": _BSD + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                    "derived from this software without specific prior written permission. " + _BSD_WARRANTY,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
            "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
            "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
            "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
            "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
            "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
            "altered from any source distribution.",
}

#: Names of licences in notices: identifier -> its spellings.
_NAMES = {
    "MIT": ["MIT License"], "ISC": ["ISC License"], "BSD": ["BSD License"], "Zlib": ["zlib License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL": ["GNU General Public License"], "LGPL": ["GNU Lesser General Public License"], "AGPL": ["GNU Affero General Public License"],
    "MPL-1.1": ["Mozilla Public License, version 1.1"], "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "EPL-1.0": ["Eclipse Public License, version 1.0"], "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
} | {f"{short}-{v}": [f"GNU {name}General Public License, version {v.removesuffix('.0')}", f"{short} version {v.removesuffix('.0')}"]
     for short, name, versions in (("GPL", "", "1.0 2.0 3.0"), ("LGPL", "Lesser ", "2.1 3.0"), ("LGPL", "Library ", "2.0"), ("AGPL", "Affero ", "3.0"))
     for v in versions.split()} | {
    f"CC-{kind}-{v}": [f"CC {kind} {v}", f"Creative Commons {words} {v} {'International' if v == '4.0' else 'Unported' if v == '3.0' else 'Generic'} License"]
    for kind, words in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
                        "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items()
    for v in ("1.0", "2.0", "2.5", "3.0", "4.0")}


def _gnu_header(license: str, version: str, later: bool = True) -> str:
    """The header that the GNU licences ask for at the top of a source file."""
    terms = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the {license} as published by the Free "
            f"Software Foundation, {terms} This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
            f"the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {license} for more details.")


def _built_in() -> dict[str, str]:
    """Headers and short texts, full texts, and the notices of all names."""
    out = dict(_HEADERS)
    for file in resources.files("opslens.llm").joinpath("license_texts").iterdir():
        if file.name.endswith(".txt"):
            out[file.name.removesuffix(".txt")] = file.read_text("utf-8")
    for name, license, version in (("GPL-2.0", "GNU General Public License", "2"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
                                   ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3")):
        out[name] = _gnu_header(license, version)
    for name, version in (("GPL-2.0-only", "2"), ("GPL-3.0-only", "3")):
        out[name] = _gnu_header("GNU General Public License", version, later=False)
    for name, spellings in _NAMES.items():
        notices = [f"{start} {x}." for x in spellings for start in (
            ("Licensed under", "Released under", "This work is licensed under") if x.startswith("CC") else
            ("Released under the", "Licensed under the", "This work is licensed under the", "This work is licensed under a"))]
        if name[-1].isdigit() or name in ("MIT", "ISC", "Zlib", "BSD-2-Clause", "BSD-3-Clause"):
            tails = [name] if name[:3] not in ("GPL", "LGP", "AGP") else [f"{name}-only", f"{name}-or-later"]
            notices += [f"SPDX-License-Identifier: {x}" for x in tails]
        free = (x for k in count(1) if (x := f"{name}-notice" + (f"-{k}" if k > 1 else "")) not in out)
        for n in notices:
            if n not in _HEADERS.values():
                out[next(free)] = n
    return out


#: Licence notices, headers and full texts.
TEMPLATES = _built_in()

_WORD = re.compile(r"[^\W_]+")
_PIECE = re.compile(r"(?<=[.!?;:])\s+|\n+")


def normalise(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


class Matcher:
    def __init__(self, templates: dict[str, str], dice: float = DICE):
        self.dice = dice
        self.sets = {n: _bigrams(normalise(t)) for n, t in sorted(templates.items())}
        self.sets = {n: s for n, s in self.sets.items() if s}
        self.ids = {pair: i for i, pair in enumerate(sorted(set().union(*self.sets.values())))}
        self.any = self.ids.keys()
        sizes = [len(s) for s in self.sets.values()]
        self.names, self.sizes = list(self.sets), np.array(sizes)
        # template x bigram; the last column stands for bigrams of no template
        self.member = np.zeros((len(sizes), len(self.ids) + 1), bool)
        for k, s in enumerate(self.sets.values()):
            self.member[k, [self.ids[pair] for pair in s]] = True

    def best(self, bigrams: set) -> tuple[float, str | None]:
        """Best template among those that the size allows."""
        n, found = len(bigrams), (0.0, None)
        low, high = n * self.dice / (2 - self.dice), n * (2 - self.dice) / self.dice
        for k in np.flatnonzero((self.sizes >= low - 1e-9) & (self.sizes <= high + 1e-9)):
            score = 2 * len(bigrams & self.sets[self.names[k]]) / (n + int(self.sizes[k]))
            if score > found[0]:
                found = (score, self.names[k])
        return found

    def possible(self, words: list[str]) -> np.ndarray:
        """The templates that may match: a window with a coefficient of ``t``
        holds at least t / (2 - t) of the template's bigrams, and all of them are
        among those of the whole text."""
        held = [i for i in map(self.ids.get, set(zip(words, words[1:]))) if i is not None]
        least = self.dice / (2 - self.dice)
        return np.flatnonzero(self.member[:, held].sum(1) >= least * self.sizes - 1e-9) if held else np.zeros(0, np.int64)

    def starts(self, hits: np.ndarray, foreign: np.ndarray, size: int) -> np.ndarray:
        """Those of a template's ``hits`` at which a window may begin: it needs t /
        (2 - t) of the template's bigrams, and has at most size * (2 - 2t) / t
        bigrams that aren't the template's. ``foreign`` counts, up to each place,
        foreign bigrams where the text has them for the first time, which are new
        in every window."""
        least = max(1, int(np.ceil(self.dice / (2 - self.dice) * size - 1e-9)))
        n = len(hits) - least + 1
        if n <= 0:
            return hits[:0]
        return hits[:n][foreign[hits[least - 1:]] - foreign[hits[:n]] <= size * (2 - 2 * self.dice) / self.dice + 1e-9]

    def longest(self, hit: np.ndarray, before: np.ndarray, size: int, a: int, limit: int) -> tuple[int, float, int]:
        """Of the windows with the coefficient that begin at bigram ``a`` and end
        before bigram ``limit``: shared less differing bigrams of the best, its
        coefficient, and its last bigram; the longest of equal ones."""
        most = size * (2 - 2 * self.dice) / self.dice + 1e-9  # foreign bigrams
        found, held, alien, lo, step = (0, 0.0, a), 0, 0, a, 2 * size + 16
        while lo < limit and alien <= most:
            hi = min(limit, lo + step)
            new = before[lo:hi] < a  # not yet in the window
            own = hit[lo:hi]
            h, f = held + np.cumsum(new & own), alien + np.cumsum(new & ~own)
            net = np.where(own & (2 * h >= (self.dice - 1e-12) * (h + f + size)), 2 * h - f - size, NONE)
            k = hi - lo - 1 - int(net[::-1].argmax())  # the last of the best
            if net[k] > NONE and (not found[1] or net[k] >= found[0]):
                found = (int(net[k]), float(2 * h[k] / (h[k] + f[k] + size)), lo + k)
            held, alien, lo, step = int(h[-1]), int(f[-1]), hi, 2 * step
        return found

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, first piece, end piece) of each match."""
        if not text or not self.sets:
            return []
        words = normalise(text)
        names = self.possible(words)
        if not len(names):
            return []
        parts = [normalise(piece) for piece in _PIECE.split(text)]
        words = [w for part in parts for w in part]
        piece = np.repeat(np.arange(len(parts)), [len(part) for part in parts])
        pairs = list(zip(words, words[1:]))
        ids = np.array([self.ids.get(pair, -1) for pair in pairs])
        before, seen = np.full(len(pairs), -1), {}
        for k, pair in enumerate(pairs):
            before[k] = seen.get(pair, -1)
            seen[pair] = k
        hits = {int(k): self.member[k][ids] for k in names}
        # the best window of each start; a start whose window meets one that was
        # taken is looked at again up to there, so the choice is as among all
        heap = []

        def push(k: int, a: int, limit: int) -> None:
            net, score, last = self.longest(hits[k], before, int(self.sizes[k]), a, limit)
            if score:
                heapq.heappush(heap, (-net, a - last, a, k, score))

        for k, hit in hits.items():
            foreign = np.cumsum(~hit & (before < 0))
            for a in self.starts(np.flatnonzero(hit), foreign, int(self.sizes[k])).tolist():
                push(k, a, len(pairs))
        begins, ends, found = [], [], []
        while heap:
            _, less, a, k, score = heapq.heappop(heap)
            last = a - less
            i = bisect.bisect_right(begins, a)
            if i and a <= ends[i - 1]:
                continue  # begins in a taken window
            if i < len(begins) and last + 1 >= begins[i]:
                push(k, a, begins[i] - 1)  # windows share no word
                continue
            begins.insert(i, a)
            ends.insert(i, last + 1)  # its last word
            found.append((self.names[k], score, int(piece[a]), int(piece[last + 1]) + 1, a))
        return [x[:4] for x in sorted(found, key=lambda x: x[4])]


@lru_cache(maxsize=2)
def _matcher(templates: tuple[tuple[str, str], ...], dice: float) -> Matcher:
    return Matcher(dict(templates), dice)


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, dice: float = DICE) -> DataFrame:
    """(doc_id, template, dice, first_piece, end_piece), one row per match."""
    table = TEMPLATES if templates is None else templates
    items = tuple(table.items())
    if sum(len(t.split()) for t in table.values()) > MAX_TEMPLATES:
        raise ValueError("templates have too many words together to go to every task")

    def scan(batches):
        matcher = _matcher(items, dice)
        for b in batches:
            ids, rows = b.column("doc_id").to_pylist(), []
            for d, text in zip(ids, b.column("text")):
                rows += [(d, *m) for m in matcher.scan(text.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()))],
                    ["doc_id", "template", "dice", "first_piece", "end_piece"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, template string, dice double, first_piece int, end_piece int")
