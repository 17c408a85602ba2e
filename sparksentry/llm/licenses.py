"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are word sequences.  Hashes of their word n-grams are winnowed (the least of every
window of consecutive hashes is kept) into an inverted index from fingerprint to template
and position; the index is broadcast, as the templates are part of the program.  A
document's n-grams are looked up in it, all of them, so every shared run of
GRAM + WINDOW - 1 words is met.  Hits of a template whose diagonals (document position
minus template position) lie close are one candidate place.  There the template is aligned
with the document's words inside a band around the diagonal: a match scores 2, a mismatch
or a gap -1.  Reported are the template's share of matched words and the span in words and
in bytes of the text.

Null, empty and wordless texts have no findings.  Repeated rows have repeated findings.
Overlapping places of a template are reported once, the better one; places that follow one
another without a word between are all reported.  Templates are judged each on its own:
licenses of one family (GNU headers) share most words, so one text can be found under
several names, with the coverage that tells them apart.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import Words, span_hashes, text_buffers, word_blocks
from .frames import map_arrow, prepare

GRAM, WINDOW, BAND = 3, 2, 8
#: Least share of a template's words that an alignment must match.
LEAST_COVERAGE = 0.8

# Notices by which works name their license, and short licenses in full.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
}


def words_of(text: str) -> Words:
    return Words(*text_buffers(pa.array([text])))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of each window, the last of equal ones."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


class TemplateIndex:
    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW):
        self.names, self.gram = list(templates), gram
        self.words = [words_of(t).hashes for t in templates.values()]
        postings = []
        for t, h in enumerate(self.words):
            if len(h) < gram:
                raise ValueError(f"the template {self.names[t]!r} has fewer than {gram} words")
            starts = np.arange(len(h) - gram + 1)
            grams = span_hashes(h, starts, starts + gram)
            postings += [(int(grams[p]), t, int(p)) for p in winnow(grams, window)]
        postings.sort()
        self.fingerprints = np.array([p[0] for p in postings], np.uint64)
        self.template = np.array([p[1] for p in postings])
        self.position = np.array([p[2] for p in postings])
        #: A small table by the top bits, which clears almost all n-grams before the search.
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.fingerprints >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(document word, template, template word) of every n-gram in the index; n-grams don't cross documents."""
        n = len(words.hashes) - self.gram + 1
        if n <= 0:
            return
        starts = np.arange(n)
        grams = span_hashes(words.hashes, starts, starts + self.gram)
        maybe = np.flatnonzero(self.maybe[(grams >> np.uint64(48)).astype(np.int64)])
        doc = np.searchsorted(words.at, maybe, side="right")
        maybe = maybe[maybe + self.gram <= words.at[doc]]
        low, high = np.searchsorted(self.fingerprints, grams[maybe], "left"), np.searchsorted(self.fingerprints, grams[maybe], "right")
        for p, a, b in zip(*(x.tolist() for x in (maybe[low < high], low[low < high], high[low < high]))):
            for i in range(a, b):
                yield p, int(self.template[i]), int(self.position[i])


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int, int]:
    """(score, matched words, first text word, end) of the best local alignment near the diagonal (text minus template)."""
    width = 2 * band + 1
    score = np.zeros(width + 2, np.int64)
    best = (0, 0, 0, 0)
    came: list[list[tuple[int, int]]] = [[(0, -1)] * (width + 2)]  # (matches, first word)
    for i, w in enumerate(template.tolist()):
        new, trail = np.zeros(width + 2, np.int64), [(0, -1)] * (width + 2)
        for c in range(1, width + 1):
            j = i + diagonal + c - 1 - band
            if not 0 <= j < len(text):
                continue
            same = int(text[j]) == w
            options = (score[c] + (2 if same else -1), score[c + 1] - 1, new[c - 1] - 1)
            k = max(range(3), key=options.__getitem__)
            if options[k] <= 0:
                continue
            matches, first = (came[-1][c], came[-1][c + 1], trail[c - 1])[k]
            matches, first = matches + (same and k == 0), first if first >= 0 else j
            new[c], trail[c] = options[k], (matches, first)
            if options[k] > best[0]:
                best = (int(options[k]), matches, first, j + 1)
        score = new
        came = [trail]
    return best


def find_licenses(index: TemplateIndex, words: Words, least: float = LEAST_COVERAGE) -> Iterator[tuple[int, int, float, int, int]]:
    """(document, template, coverage, first word, end word) in a block, without overlaps of a template."""
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    for p, t, at in index.hits(words):
        doc = int(np.searchsorted(words.at, p, side="right")) - 1
        places[doc, t].add(p - int(words.at[doc]) - at)
    for (doc, t), diagonals in sorted(places.items()):
        text = words.hashes[words.at[doc] : words.at[doc + 1]]
        for coverage, first, end in places_of(index.words[t], text, diagonals, least):
            yield doc, t, coverage, first, end


def places_of(template: np.ndarray, text: np.ndarray, diagonals: Iterable[int], least: float) -> list[tuple[float, int, int]]:
    """(coverage, first word, end word) near the diagonals, without overlaps, better ones first.

    A window can hold several places, of which an alignment gives one; so windows are aligned
    again in the words that no place has taken, until that gives nothing new.
    """
    taken: list[tuple[int, int]] = []
    out: list[tuple[float, int, int]] = []
    pending = sorted(diagonals)
    whole = [d for d in pending if 0 <= d <= len(text) - len(template) and (text[d : d + len(template)] == template).all()]
    found = {(1.0, d, d + len(template)) for d in whole}
    while True:
        for coverage, first, end in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
            at = bisect_left(taken, (first, end))
            if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or end <= taken[at][0]):
                taken.insert(at, (first, end))
                out.append((coverage, first, end))
        found, left = set(), []
        for d in pending:
            lo, hi = max(0, d - BAND), min(len(text), d + len(template) + BAND)
            fits = []
            for a, b in free(taken, lo, hi):
                if may_fit(template, text[a:b], least):
                    _, matches, first, end = align(template, text[a:b], d - a)
                    if matches / len(template) >= least:
                        fits.append((matches / len(template), first + a, end + a))
            if fits:
                found.update(fits)
                left.append(d)
        pending = left
        if not found:
            return out


def may_fit(template: np.ndarray, text: np.ndarray, least: float) -> bool:
    """False only if so few of the template's words stand in the text that no alignment can match enough."""
    return len(text) >= least * len(template) and np.isin(template, text).sum() / len(template) >= least


def free(taken: list[tuple[int, int]], lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """The parts of lo to hi outside the spans, which are in order and don't overlap."""
    for a, b in taken[max(0, bisect_left(taken, (lo,)) - 1) :]:
        if a >= hi:
            break
        if lo < a:
            yield lo, a
        lo = max(lo, b)
    if lo < hi:
        yield lo, hi


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, license, coverage, first_word, end_word, first_byte, end_byte of every finding in (doc_id, text)."""
    prepare(docs.sparkSession)
    templates = templates or TEMPLATES
    made: list[TemplateIndex] = []

    def of_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        if not made:
            made.append(TemplateIndex(templates))
        index = made[0]
        for lo, hi, words in word_blocks(batch.column("text")):
            rows = list(find_licenses(index, words, least))
            doc = np.array([r[0] for r in rows], np.int64)
            first, end = (np.array([r[k] for r in rows], np.int64) for k in (3, 4))
            base = words.at[doc]
            starts = np.array([words.starts[w] for w in base + first], np.int64) - words.offsets[doc]
            ends = np.array([words.ends[w] for w in base + end - 1], np.int64) - words.offsets[doc]
            yield {"doc_id": batch.column("doc_id").take(pa.array(doc + lo)), "license": pa.array([index.names[r[1]] for r in rows], pa.string()), "coverage": np.array([r[2] for r in rows], float), "first_word": first, "end_word": end, "first_byte": starts, "end_byte": ends}

    return map_arrow(docs.select("doc_id", "text"), of_batch, "doc_id long, license string, coverage double, first_word long, end_word long, first_byte long, end_byte long")
