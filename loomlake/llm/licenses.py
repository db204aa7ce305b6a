"""License scans: winnowed template fingerprints pick candidates, banded alignment reports them.

The templates' winnowed word k-grams, and all word pairs of short templates, form an inverted index
(hash -> template, place) whose size is fixed by the template list.  A document's fingerprints look candidates up; hits of one template
on nearby diagonals make one candidate place, and a banded local alignment of the template with
the document there gives the words in common, the coverage and the span.  Everything happens
in one pass over the documents, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm.common import packs, tidy, utf8
from loomlake.llm.words import ALNUM, Words, found, grams, winnow, words

# Public license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "ISC-disclaimer": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-no-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}

# Words that make a licence another one.  They have to be the same in a template and in a place of it.
DECIDING = "nc nd sa noncommercial noderivatives noderivs sharealike lesser affero"
# A number behind one of these, or behind another such number, is a version, which a place has to hold.
BEFORE_VERSIONS = "version v license licence by nc nd sa attribution noncommercial noderivatives sharealike"

#: Bytes of templates that one index may hold; it is broadcast.
MOST_BYTES = 64 << 20


def read_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Templates from a folder of text files (whole licences, say), each named by its file without the extension.

    A folder of more than ``MOST_BYTES`` is refused, as the index is broadcast.
    """
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    if size > MOST_BYTES:
        raise ValueError(f"templates of {size} bytes; at most {MOST_BYTES} can be broadcast")
    name = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "")
    return {r["name"]: r["text"] for r in files.select(name.alias("name"), F.decode("content", "UTF-8").alias("text")).collect()}

_FOUND = "doc_id bigint, license string, coverage double, n_matched int, n_words int, word_start int, word_end int, byte_start bigint, byte_end bigint"
_KIND = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int32()), ("n_words", pa.int32()), ("word_start", pa.int32()), ("word_end", pa.int32()), ("byte_start", pa.int64()), ("byte_end", pa.int64())])


def align(template: np.ndarray, doc: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Words in common, first and end word of the best alignment of a whole template within ``doc``.

    The i-th template word may meet document words from i + shift - band to i + shift + band.  The
    alignment with most common words wins; of several, the one with the fewest document words.
    """
    width = 2 * band + 1
    low = -(1 << 40)
    # Scores carry both aims: a common word counts 2**20, a document word inside the span costs 1.
    gain = 1 << 20
    best = np.zeros(width, np.int64)  # row 0: nothing matched; the span starts anywhere
    begin = shift - band + np.arange(width)
    top = (0, 0, 0)
    for i in range(len(template)):
        at = i + shift - band + np.arange(width)
        inside = (at >= 0) & (at < len(doc))
        same = np.zeros(width, bool)
        same[inside] = doc[at[inside]] == template[i]
        # Band index c of row i is document word i + shift - band + c; a step down moves one to the left.
        skip = np.append(best[1:], low)  # this template word has no partner
        skip_from = np.append(begin[1:], 0)
        fresh = best <= 0
        take = np.where(same, np.where(fresh, 0, best) + gain - 1, low)
        take_from = np.where(fresh, at, begin)
        use = same & (take >= skip)
        best, begin = np.where(use, take, skip), np.where(use, take_from, skip_from)
        for c in range(1, width):  # a document word without a partner
            if best[c - 1] > 0 and best[c - 1] - 1 > best[c] and not use[c]:
                best[c], begin[c] = best[c - 1] - 1, begin[c - 1]
        # best[c] is a state after document word at[c]; the next diagonal step is from c in the next row.
        c = int(best.argmax())
        if best[c] > top[0]:
            top = (int(best[c]), int(begin[c]), int(at[c]) + 1)
    return -(-top[0] // gain), top[1], top[2]


def versions(template: str) -> list[np.ndarray]:
    """Hashes of a template's version numbers: runs of numbers behind a word of ``BEFORE_VERSIONS``."""
    names = [w.decode(errors="replace").lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", template.encode())]
    hashes = words([template.encode()], ALNUM).hashes
    before, out, run = set(BEFORE_VERSIONS.split()), [], []
    for i in range(len(names) + 1):
        if i < len(names) and names[i].isdigit() and i and (run or names[i - 1] in before):
            run.append(hashes[i])
        elif run:
            out.append(np.array(run))
            run = []
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], gram: int, window: int, band: int, least: float):
        self.names, self.gram, self.window, self.band, self.least = sorted(templates), gram, window, band, least
        self.words = words([templates[n].encode() for n in self.names], ALNUM)
        sizes = np.diff(self.words.bounds)
        # 0.8 of n words, in the runs that the others leave, hold a run of 4 if n is over 3 / (1 - 0.8).
        self.short = sizes * (1 - least) <= gram + window - 2
        # (words of a gram, window, its index, its keys): short templates by all their pairs, or their only word.
        self.levels = []
        for k, w, members in ((gram, window, ~self.short), (2, 1, self.short & (sizes > 1)), (1, 1, self.short & (sizes == 1))):
            g = grams(self.words.hashes, k)
            index: dict[int, list[int]] = defaultdict(list)
            for p in winnow(g, self.words.text, k, w).tolist():
                if members[self.words.text[p]]:
                    index[int(g[p])].append(p)
            if index:
                self.levels.append((k, w, dict(index), np.array(sorted(index), np.uint64)))
        self.deciding = np.unique(words([DECIDING.encode()], ALNUM).hashes)
        self.versions = [versions(templates[n]) for n in self.names]
        self.named = [self.decided(self.template(n)) for n in range(len(self.names))]

    def template(self, n: int) -> np.ndarray:
        return self.words.hashes[self.words.bounds[n] : self.words.bounds[n + 1]]

    def decided(self, doc: np.ndarray) -> list[int]:
        return doc[found(self.deciding, doc)[0]].tolist()

    def same_licence(self, n: int, doc: np.ndarray) -> bool:
        """Whether a place has the template's deciding words, in order and no others, and its version numbers."""
        held = doc.tolist()
        runs = [[int(h) for h in r] for r in self.versions[n]]
        return self.decided(doc) == self.named[n] and all(any(held[i : i + len(r)] == r for i in range(len(held) - len(r) + 1)) for r in runs)

    def scan(self, doc: Words):
        """(text of the slice, template, words in common, template words, first word, end) of each match."""
        shifts: dict[tuple[int, int], set[int]] = defaultdict(set)
        for k, w, index, keys in self.levels:
            g = grams(doc.hashes, k)
            at = winnow(g, doc.text, k, w)
            hit, _ = found(keys, g[at])
            for p in at[hit].tolist():
                for q in index[int(g[p])]:
                    n = int(self.words.text[q])
                    shifts[int(doc.text[p]), n].add(p - q + int(self.words.bounds[n]))
        found_in: dict[int, list[tuple]] = defaultdict(list)
        for (t, n), all_shifts in sorted(shifts.items()):
            template = self.template(n)
            first, end = int(doc.bounds[t]), int(doc.bounds[t + 1])
            find = self.apart if self.short[n] else self.spread
            for same, a, b in find(template, doc.hashes, first, end, self.likely(template, doc.hashes, first, end, all_shifts)):
                if self.same_licence(n, doc.hashes[a:b]):
                    found_in[t].append((same, len(template), a - first, b - first, n))
        for t, places in sorted(found_in.items()):
            for same, size, a, b, n in self.outermost(places):
                yield t, n, same, size, a, b

    def likely(self, template: np.ndarray, doc: np.ndarray, first: int, end: int, shifts: set[int]) -> list[int]:
        """The diagonals, in order, in whose band enough of the text's words are words of the template at all.

        Pairs of plain words are in every text; this passes over most of them without an alignment.
        """
        band = max(self.band, len(template))
        ours = np.append(0, np.cumsum(np.isin(doc[first:end], template)))
        at = np.array(sorted(shifts), np.int64) - first
        lo, hi = np.clip(at - band, 0, end - first), np.clip(at + len(template) + band, 0, end - first)
        return (at[ours[hi] - ours[lo] >= self.least * len(template)] + first).tolist()

    def outermost(self, places: list[tuple]) -> list[tuple]:
        """Without those that lie within the place of another template that has more words in common there."""
        places, out, open_ = sorted(places, key=lambda x: (x[2], -x[3])), [], []
        for i, x in enumerate(places):
            # Places that begin at or before this one and end at or after it can hold it; few reach so far.
            open_ = [y for y in open_ if y[3] > x[2]] + [x]
            same_start = []
            for y in places[i + 1 :]:
                if y[2] != x[2]:
                    break
                same_start.append(y)
            if not any(y[0] > x[0] and y[4] != x[4] and y[2] <= x[2] and x[3] <= y[3] for y in (*open_, *same_start)):
                out.append(x)
        return out

    def spread(self, template: np.ndarray, doc: np.ndarray, first: int, end: int, shifts: list[int]) -> list[tuple[int, int, int]]:
        """(words in common, first word, end) of a long template's places, best first, none overlapping another."""
        band, size, tried, previous = min(self.band, len(template) // 2), len(template), [], None
        for shift in shifts:
            # Diagonals within half a band of one that was aligned are in its band, with room to both sides.
            if previous is not None and shift - previous <= band // 2:
                continue
            previous = shift
            lo = max(first, shift - band)
            same, a, b = align(template, doc[lo : min(end, shift + size + band)], shift - lo, band)
            if same >= self.least * size:
                tried.append((-same, b - a, lo + a, lo + b))
        taken: list[tuple[int, int, int]] = []
        for same, _, a, b in sorted(tried):
            i = bisect(taken, (a, b))
            if not any(x[0] < b and a < x[1] for x in taken[max(i - 1, 0) : i + 1]):
                taken.insert(i, (a, b, -same))
        return [(same, a, b) for a, b, same in taken]

    def apart(self, template: np.ndarray, doc: np.ndarray, first: int, end: int, shifts: list[int]) -> list[tuple[int, int, int]]:
        """(words in common, first word, end) of a short template's places, best first, none within another.

        The band is the template's length, so it holds neighbours too: a diagonal whose best place is taken
        is aligned again in what is free beside it.
        """
        size, taken, waiting = len(template), [], []
        band = max(self.band, size)

        def wait(shift: int, lo: int, hi: int) -> None:
            lo, hi = max(lo, shift - band), min(hi, shift + size + band)
            if hi - lo < self.least * size:
                return
            same, a, b = align(template, doc[lo:hi], shift - lo, band)
            if same >= self.least * size:
                heappush(waiting, (-same, b - a, lo + a, lo + b, shift, lo, hi))

        for shift in shifts:
            wait(shift, first, end)
        while waiting:
            same, _, a, b, shift, lo, hi = heappop(waiting)
            i = bisect(taken, (a, b))
            # Taken spans are in order and disjoint; of those that meet this one, any splits what is left.
            meets = next((x for x in taken[max(i - 1, 0) : i + 1] if x[0] < b and a < x[1]), None)
            if meets is None:
                taken.insert(i, (a, b, -same))
            else:
                wait(shift, lo, min(hi, meets[0]))
                wait(shift, max(lo, meets[1]), hi)
        return [(same, a, b) for a, b, same in taken]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, gram: int = 3, window: int = 2, band: int = 8, least: float = 0.8) -> DataFrame:
    """A row for each place of a document that holds at least ``least`` of a template's words in order.

    Rows: doc_id, license, coverage, n_matched, n_words (of the template), and the span in words and
    in bytes of the text.  Candidates of a template of over ``(gram + window - 2) / (1 - least)`` (15) words
    are all shared runs of ``gram + window - 1`` (4) words; a match has one unless words are put in between,
    and those may shift it by ``band`` words.  Candidates of a shorter template are all shared pairs of
    neighbouring words (of a single word, that word), and words put in between may shift the others by
    ``band`` words or the template's length, whichever is more.  Places of one template don't overlap; the one
    with most words in common goes first.  Words that make a licence another one (``DECIDING``) have to be the same in a
    place and its template, and a template's version numbers have to be there, whatever the coverage.  A place within that of another template with more words in common there
    (a notice that is part of a licence) isn't reported.  Null and empty texts give no rows; repeated rows give
    their own; other columns are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates or TEMPLATES, gram, window, band, least))

    def scan(batches):
        s = shared.value
        for batch in batches:
            ids, texts, out = batch.column(0).to_pylist(), utf8(batch.column(1)), []
            for lo, hi in packs(texts):
                w = words(texts[lo:hi], ALNUM)
                for t, n, same, size, a, b in s.scan(w):
                    first, base = int(w.bounds[t]), int(w.offsets[t])
                    out.append((ids[lo + t], s.names[n], same / size, same, size, a, b, int(w.starts[first + a]) - base, int(w.ends[first + b - 1]) - base))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(_KIND), _KIND)], schema=_KIND)

    return docs.select("doc_id", "text").mapInArrow(tidy(scan), _FOUND)
