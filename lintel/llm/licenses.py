"""License scan: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies.

Texts and templates are lower-cased words [^\\x20\\x09-\\x0D]+ without punctuation at their ends; a shingle is 5
consecutive words. Windows of a text overlap by a stride; windows of a template start at every word. Window lengths
go with the template: a template of under 10 words gives windows of 5 words (stride 1), of under 57 words windows of
8 (stride 2), else windows of 16 (stride 4). A window's MinHash signature is cut into bands.

Why retrieval is complete for containment >= 0.8 where single words of a template are changed: k changes spoil up to 5k
shingles, at most a fifth of n - 4, so n >= 25k + 4, and one of the k + 1 stretches between them has (n - k) / (k + 1)
words or more: 9 at least for n >= 10, and 19 from n = 57 on. A stretch of a window plus its stride less one holds one of the
text's windows whole, which equals a template window and collides in every band. Windows that are merely similar
(Jaccard 0.8) collide with probability 1 - (1 - 0.64)^8 > 0.999 at 16 words.

A collision gives the template and where it would begin; the share of its shingles that stand in the text around
that place is then counted exactly, and 0.8 or more is a match. Collisions that no match covers are joined, from one match
of their template to the next, into one stretch whose shingles are counted alike: words put into a template, however
many, spoil no more than the shingles that they cut. Of overlapping matches of templates that are alike by half
(versions, or one with a clause more) that with the most shingles stays. Templates are a parameter of bounded size;
each text is scanned on its own, in one narrow stage without a shuffle.

Defined cases: a null or empty text has no match; a text or template of fewer than 5 words is one shingle, its whole
sequence; a very long text is scanned whole; rows are reported one by one, repeated or not; of equally good matches the first
stays; an empty table gives no rows; columns other than doc_id and text are not read.
"""

import pkgutil
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.text import SOLID, mixed, slices, span_hashes, utf8, word_bounds, word_hashes

SHINGLE, CONTAINED = 5, 0.8
#: From this many words of a template on: words of a window, stride in a text, bands, rows of a band.
WINDOWS = ((0, 5, 1, 1, 1), (10, 8, 2, 4, 1), (57, 16, 4, 8, 2))

_GIVEN = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_UNNAMED = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS “AS IS” AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_HEADER = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."


def _whole(name: str) -> str:
    return pkgutil.get_data("lintel.llm", f"license_texts/{name}.txt").decode()


#: Notices, headers and whole texts of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the “Software”), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-header": _HEADER.format("program", ":", "Affero ", ",", "3"),
    "apache-2.0-text": _whole("Apache-2.0"),
    "bsd-2-clause": "Released under the BSD 2-Clause License.",
    "bsd-2-clause-text": f"{_GIVEN} {_AS_IS}",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "bsd-3-clause-text": f"{_GIVEN} {_UNNAMED} {_AS_IS}",
    "cc0-1.0-text": _whole("CC0-1.0"),
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": _HEADER.format("program", ";", "", ";", "2"),
    "gpl-2.0-text": _whole("GPL-2"),
    "gpl-3.0-text": _whole("GPL-3"),
    "isc": "Released under the ISC License.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED “AS IS” AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "lgpl-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-2.1-header": _HEADER.format("library", ";", "Lesser ", ";", "2.1"),
    "lgpl-2.1-text": _whole("LGPL-2.1"),
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3.0-header": _HEADER.format("library", ":", "Lesser ", ",", "3"),
    "lgpl-3.0-text": _whole("LGPL-3"),
    "mit-licensed": "Licensed under the MIT License.",
    "mpl-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2.0-text": _whole("MPL-2.0"),
} | {
    f"{kind.lower().replace(' ', '-')}-{version}{end}": lead.format(f"{kind} {version}", f"{name} {version}")
    for kind, name in {"CC BY": "Attribution", "CC BY-SA": "Attribution-ShareAlike", "CC BY-NC": "Attribution-NonCommercial", "CC BY-ND": "Attribution-NoDerivatives", "CC BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "CC BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items()
    for version in ("2.0", "3.0", "4.0")
    for end, lead in {"": "Licensed under {0}.", "-header": "This work is licensed under a Creative Commons {1} International License.", "-unported": "This work is licensed under a Creative Commons {1} Unported License."}.items()
}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
#: Word bytes once punctuation, but for signs inside names and versions, is a gap.
_WORD = SOLID.copy()
_WORD[[ord(c) for c in "\"'`()[]{}<>,;:!?*|#"]] = False
_DOT = np.zeros(256, bool)
_DOT[ord(".")] = True


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, full stops at the end of a word left off, and each row's first word."""
    data = _FOLD[data]
    starts, ends, first = word_bounds(data, bounds, _WORD)
    if len(ends):
        ends = ends - (_DOT[data[ends - 1]] & (ends - starts > 1))
    return word_hashes(data, starts, ends), first


def _salts(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(99)).integers(1, 1 << 63, n, dtype=np.uint64)


def _signatures(shingles: np.ndarray, begins: np.ndarray, per_window: int, bands: int, rows: int) -> Iterator[np.ndarray]:
    """For each band, a hash of the windows' MinHash values in it."""
    salts = _salts(bands * rows)
    for band in range(bands):
        out = np.zeros(len(begins), np.uint64)
        for salt in salts[band * rows : (band + 1) * rows]:
            hashed = mixed(shingles ^ salt)
            least = hashed[begins]
            for k in range(1, per_window):
                least = np.minimum(least, hashed[begins + k])
            out = mixed(out ^ least) + np.uint64(band)
        yield out


class Templates:
    """Shingles of the templates and their windows' bands."""

    def __init__(self, templates: dict[str, str], shingle: int = SHINGLE):
        self.names, self.shingle = sorted(templates), shingle
        self.sets: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.bands: dict[int, list[dict[int, list[tuple[int, int]]]]] = {}
        for t, name in enumerate(self.names):
            words, _ = _words(*utf8(pa.array([templates[name]], pa.string())))
            n = len(words)
            size = min(n, shingle)
            at = np.arange(max(0, n - size + 1)) if n else np.zeros(0, np.int64)
            shingles = span_hashes(words, at, at + size)
            self.sets.append(np.unique(shingles))
            self.lengths.append(n)
            if n < shingle:
                continue  # looked up by its one shingle
            window, bands, rows = next((w, b, r) for least, w, _, b, r in WINDOWS[::-1] if n >= least)
            begins = np.arange(n - window + 1)
            tables = self.bands.setdefault(window, [{} for _ in range(bands)])
            for table, values in zip(tables, _signatures(shingles, begins, window - shingle + 1, bands, rows)):
                for begin, value in enumerate(values.tolist()):
                    table.setdefault(value, []).append((t, begin))
        self.keys = {w: [np.fromiter(table, np.uint64, len(table)) for table in tables] for w, tables in self.bands.items()}
        alike = lambda a, b: 2 * len(np.intersect1d(a, b)) >= len(np.union1d(a, b)) > 0
        self.rivals = {(x, y) for x, a in zip(self.names, self.sets) for y, b in zip(self.names, self.sets) if x != y and len(a) <= 2 * len(b) <= 4 * len(a) and alike(a, b)}


@lru_cache(4)
def _known(templates: tuple[tuple[str, str], ...]) -> Templates:
    """The templates, made once in a Python worker."""
    return Templates(dict(templates))


def _scan(templates: dict[str, str], contained: float):
    def matches_of(words: np.ndarray, first: np.ndarray, known: Templates) -> list[list[tuple]]:
        rows = len(first) - 1
        row = np.repeat(np.arange(rows), np.diff(first))
        n, k = len(words), known.shingle
        at = np.flatnonzero(row[: n - k + 1] == row[k - 1 :]) if n >= k else np.zeros(0, np.int64)
        shingles = np.zeros(n, np.uint64)
        shingles[at] = span_hashes(words, at, at + k)
        guesses: set[tuple[int, int, int]] = set()  # row, template, word at which the template would begin
        met: dict[tuple[int, int], set[tuple[int, int]]] = {}  # row, template: windows that collide
        for _, window, stride, bands, per_band in WINDOWS:
            tables = known.bands.get(window)
            if not tables or n < window:
                continue
            whole = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
            begins = whole[((whole - first[row[whole]]) % stride == 0) | (np.append(row[whole][1:], -1) != row[whole])]
            for table, keys, values in zip(tables, known.keys[window], _signatures(shingles, begins, window - k + 1, bands, per_band)):
                for i in np.flatnonzero(np.isin(values, keys)).tolist():
                    for t, offset in table[int(values[i])]:
                        guesses.add((int(row[begins[i]]), t, int(begins[i]) - offset))
                        met.setdefault((int(row[begins[i]]), t), set()).add((int(begins[i]), int(begins[i]) + window))
        for t, length in enumerate(known.lengths):
            if 0 < length < k:  # a whole sequence of few words, anywhere
                spot = np.flatnonzero(row[: n - length + 1] == row[length - 1 :]) if n >= length else np.zeros(0, np.int64)
                for i in spot[span_hashes(words, spot, spot + length) == known.sets[t][0]].tolist():
                    guesses.add((int(row[i]), t, i))
        out: list[list[tuple]] = [[] for _ in range(rows)]

        def count(r: int, t: int, lo: int, hi: int) -> None:
            size = min(known.lengths[t], k)
            spots = np.arange(lo, hi - size + 1)
            around = shingles[spots] if size == k else span_hashes(words, spots, spots + size)
            own = known.sets[t]  # in order
            place = np.minimum(np.searchsorted(own, around), len(own) - 1)
            inside = own[place] == around
            share = np.count_nonzero(np.bincount(place[inside], minlength=1)) / len(own)
            if share >= contained:
                held = spots[inside]
                out[r].append((known.names[t], share, int(held[0] - first[r]), int(held[-1] + size - first[r]), round(share * len(known.sets[t]))))

        for r, t, begin in sorted(guesses):
            slack = known.lengths[t] // 5 + 1
            count(r, t, max(begin - slack, int(first[r])), min(begin + known.lengths[t] + slack, int(first[r + 1])))
        out = [_best(x) for x in out]
        for (r, t), windows in met.items():
            taken = sorted((m[2] + int(first[r]), m[3] + int(first[r])) for m in out[r] if m[0] == known.names[t])
            # Gaps between matches lie one behind the other, so each window is looked at for one of them.
            windows = sorted(windows)
            for lo, hi in zip([int(first[r]), *(e for _, e in taken)], [*(b for b, _ in taken), int(first[r + 1])]):
                rest = [w for w in windows[bisect_left(windows, (lo, 0)) : bisect_left(windows, (hi, 0))] if w[1] <= hi]
                if rest:  # the edges of a template may be too short for a window of their own
                    count(r, t, max(lo, min(rest)[0] - known.lengths[t]), min(hi, max(e for _, e in rest) + known.lengths[t]))
        return [[m[:4] for m in _strongest(_best(x), known.rivals)] for x in out]

    def batches(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(tuple(sorted(templates.items())))
        kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())]))
        for batch in items:
            n_words, found = [], []
            for lo, hi in slices(batch.column("text")):
                words, first = _words(*utf8(batch.column("text").slice(lo, hi - lo)))
                n_words += np.diff(first).tolist()
                found += [[dict(zip(("license", "containment", "begin", "end"), m)) for m in x] for x in matches_of(words, first, known)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "matches"])

    return batches


def _best(matches: list[tuple]) -> list[tuple]:
    """Of matches of one template that overlap, the one with the highest containment, the first of equals."""
    kept: dict[str, list[tuple[int, int]]] = {}
    out = []
    for m in sorted(matches, key=lambda m: (-m[1], m[2], m[3], m[0])):
        # Kept ones are apart, in order of begin and end: the last that begins before this one ends is the only one to look at.
        own = kept.setdefault(m[0], [])
        k = bisect_left(own, (m[3], 0))
        if not (k and own[k - 1][1] > m[2]):
            own.insert(k, (m[2], m[3]))
            out.append(m)
    return sorted(out, key=lambda m: (m[2], m[0], m[3]))


def _strongest(matches: list[tuple], rivals: set[tuple[str, str]]) -> list[tuple]:
    """Without matches that overlap one of a rival template with more shingles, or as many and a higher containment; matches from _best()."""
    by_name: dict[str, list[tuple]] = {}
    for m in matches:
        by_name.setdefault(m[0], []).append(m)
    begins = {name: [m[2] for m in own] for name, own in by_name.items()}
    against = {name: [x for x in by_name if (x, name) in rivals] for name in by_name}

    def beaten(m: tuple) -> bool:
        for name in against[m[0]]:
            k = bisect_left(begins[name], m[3]) - 1
            while k >= 0 and by_name[name][k][3] > m[2]:
                if (by_name[name][k][4], by_name[name][k][1]) > (m[4], m[1]):
                    return True
                k -= 1
        return False

    return [m for m in matches if not beaten(m)]


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_words and matches (license, containment, begin and end in words) for every row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan(dict(templates), contained), "doc_id long, n_words long, matches array<struct<license:string,containment:double,begin:long,end:long>>")
