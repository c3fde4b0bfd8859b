"""License scans: winnowed fingerprints pick templates, banded alignment says how much of one is there.

The inverted index over a few templates is small and fixed, so it goes to tasks with the code; texts are not shuffled.
Words outside the templates cannot be in a shared fingerprint, so only runs of known words are hashed.
"""

from __future__ import annotations

import re
from bisect import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from soukspark.llm.common import WORD

#: Fixed texts: notices by which public licenses are commonly announced.
TEMPLATES = {
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT (line)": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause (clause)": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "MIT (warranty)": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Words of a fingerprint, fingerprints of a window: any match of GRAM + WINDOW - 1 words shares a fingerprint.
GRAM, WINDOW = 3, 3
#: How far an alignment may leave its diagonal, and the least share of a template's words that is reported.
BAND, COVERAGE = 8, 0.8
_NONE = np.uint64(2**64 - 1)
_TRIM = re.compile(r"^\W+|\W+$")
AT_ONCE = 1 << 23


def plain(word: str) -> str:
    return _TRIM.sub("", word.lower())


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        texts = [[p for w in re.findall(WORD, t) if (p := plain(w))] for t in templates.values()]
        self.ids = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        self.words = [np.array([self.ids[w] for w in t]) for t in texts]
        posts = [(h, t, p) for t, w in enumerate(self.words) for p, h in zip(*winnow(w, np.zeros(len(w), np.int64)), strict=True)]
        posts.sort()
        self.hash = np.array([h for h, _, _ in posts], np.uint64)
        self.post = np.array([(t, p) for _, t, p in posts], np.int64).reshape(-1, 2)


def winnow(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the selected grams of known words (ids; -1: unknown) of documents. Of each window
    of grams the last of the smallest hashes; windows reach over both ends."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        known = doc[:n] == doc[GRAM - 1 :]
        for k in range(GRAM):
            part = words[k : k + n]
            h = (h ^ (part + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            known &= part >= 0
    h = np.where(known, h, _NONE)
    pad = np.full(WINDOW - 1, _NONE)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((pad, h, pad)), WINDOW)
    last = WINDOW - 1 - windows[:, ::-1].argmin(1)
    at = np.unique(np.arange(len(windows)) + last) - (WINDOW - 1)
    at = at[(at >= 0) & (at < n)]
    at = at[h[at] != _NONE]
    return at, h[at]


def align(doc: np.ndarray, template: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Most template words matched in order within BAND of the diagonal, doc place = template place + shift, and
    the places of the first and last matched words of the document; of equal counts the shortest span."""
    width = 2 * BAND + 1
    # of each cell of a row: matched words, minus where the span starts, minus where it ends
    row = [(0, 0, 0)] * (width + 1)
    for t, word in enumerate(template.tolist()):
        new = []
        for j in range(width):
            at = t + shift + j - BAND
            best = row[j + 1]  # the template's word is left out
            if j and new[-1] > best:
                best = new[-1]  # the document's word is left out
            if 0 <= at < len(doc) and doc[at] == word:
                n, start, _ = row[j]
                got = (n + 1, start if n else -at, -at)
                best = max(best, got)
            new.append(best)
        row = [*new, (0, 0, 0)]
    n, start, end = max(row)
    return n, -start, -end


def scan_words(index: Index, words: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """``(document, template, matched, first, last)``, places within the document, of documents one after another."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at, h = winnow(words, doc)
    low, high = np.searchsorted(index.hash, h), np.searchsorted(index.hash, h, "right")
    hit = np.flatnonzero(high > low)
    found: dict[tuple, list] = {}
    for k in hit.tolist():
        for t, p in index.post[low[k] : high[k]].tolist():
            found.setdefault((int(doc[at[k]]), t), []).append(int(at[k]) - p)
    out: dict[int, list] = {}
    for (d, t), shifts in found.items():
        text = words[offsets[d] : offsets[d + 1]]
        last = None
        for s in sorted(set(shifts)):
            if last is not None and s - last <= BAND // 2:
                continue  # within the band of the alignment before
            last = s
            n, a, b = align(text, index.words[t], s - int(offsets[d]))
            if n >= COVERAGE * len(index.words[t]):
                out.setdefault(d, []).append((n, -(b - a), -a, -t, a, b))
    rows = []
    for d, all_ in out.items():
        taken: list[tuple] = []  # disjoint spans in order, so only the neighbours can overlap
        for n, _, _, t, a, b in sorted(all_, reverse=True):
            k = bisect(taken, (a, b))
            if (not k or taken[k - 1][1] < a) and (k == len(taken) or b < taken[k][0]):
                taken.insert(k, (a, b))
                rows.append((d, -t, n, a, b))
    return sorted(rows, key=lambda r: (r[0], r[3]))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``key, license, coverage, matched_words, start, end``: one row for each notice found, in whole texts.

    coverage: the share of the template's words matched in order; start, end: the span in characters, from 0, end
    excluded. Of overlapping finds the one with more words stays; of equal ones that of the shorter span, then the
    earlier one, then that of the template named first. Null and empty texts have none; a text of any length is scanned
    whole. Keys may repeat or be null; each row is scanned. An empty table gives no rows. Other columns are not read.
    """
    kind = dict(docs.dtypes)[key]
    pattern = re.compile(WORD)

    def of(batches):
        index = Index(templates)
        for whole in batches:
            texts = pc.fill_null(whole.column(1), "")
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(size):
                stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + AT_ONCE, "right")))
                part = texts.slice(start, stop - start)
                split = pc.ascii_split_whitespace(part)
                offsets = np.asarray(split.offsets).astype(np.int64)
                coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
                offsets -= offsets[0]
                known = np.array([index.ids.get(p, -1) if (p := plain(w)) else -2 for w in coded.dictionary.to_pylist()], np.int64)
                words = known[coded.indices.to_numpy(zero_copy_only=False)]
                real = words != -2  # pieces without a letter or digit are no words
                before = np.concatenate(([0], np.cumsum(real)))
                rows = scan_words(index, words[real], before[offsets])
                place = np.flatnonzero(real)
                spans = []
                held, marks = None, []
                for d, t, n, a, b in rows:
                    if d != held:
                        held, marks = d, [m.span() for m in pattern.finditer(part[d].as_py())]
                        pieces = part[d].as_py()
                        skip = int(bool(pieces[:1] and pieces[0] in " \t\n\x0b\x0c\r"))
                    base = int(offsets[d]) + skip
                    first, last = (int(place[before[offsets[d]] + x]) - base for x in (a, b))
                    spans.append((start + d, index.names[t], n / len(index.words[t]), n, marks[first][0], marks[last][1]))
                at = pa.array([s[0] for s in spans], pa.int64())
                columns = [pa.array([s[k] for s in spans], t) for k, t in ((1, pa.string()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()), (5, pa.int64()))]
                yield pa.RecordBatch.from_arrays([whole.column(0).take(at), *columns], [key, "license", "coverage", "matched_words", "start", "end"])
                start = stop

    return docs.select(key, text).mapInArrow(of, f"`{key}` {kind}, license string, coverage double, matched_words long, start long, end long")
