"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates are lower-cased words, shingled by five. A template of s shingles belongs to the size class c, the
power of two at or above s. Windows of class c are c + c/4 shingles long and start every c/4 shingles (c and 1 for
classes under 4), so that any run of c shingles lies whole in one window, and a window that holds 80 % of a template
has a Jaccard similarity of at least 0.29 with it. Each of 32 permutations is a band of its own: such a window agrees
with the template in one of them with a chance over 0.9999. A window that agrees is compared by its shingles
themselves, and only a containment of ``least`` or more counts.

A window can share a minimum with a template only if it holds a shingle of it, so signatures are computed only for
windows around such shingles. All is done within a row: no shuffle, whatever the skew.

Defined cases: a null or empty text has no match; a template or text under five words is one shingle of all its words
(and can then match only as a whole); overlapping matches of one template are one; repeated rows match alike.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_arrow, raw, table

#: Public licence texts and notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-short-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-short-notice": "Licensed under CC BY-SA 4.0.",
    "bsd-notice": "Use of this source code is governed by a BSD-style license.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "boost-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
WORDS = re.compile(r"\w+")
SHINGLE, BANDS, LEAST = 5, 32, 0.8
TABLE_BITS = 18


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)] or ([tuple(words)] if words else [])


def _hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of the shingles of ``words``: word hashes mixed by place."""
    from xxhash import xxh3_64_intdigest

    own = np.array([xxh3_64_intdigest(w) for w in words], np.uint64) if words else np.zeros(0, np.uint64)
    n = max(1, len(own) - SHINGLE + 1) if len(own) else 0
    width = min(SHINGLE, len(own))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ own[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Scanner:
    """Template signatures by size class and band, and the shingles that any template has."""

    def __init__(self, templates: dict[str, str], least: float = LEAST):
        self.least = least
        rng = np.random.default_rng(5)
        self.mul, self.add = rng.integers(0, 1 << 63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, BANDS, np.uint64)
        self.exact, self.bands, self.classes = {}, {}, set()
        every = []
        for name, text in sorted(templates.items()):
            words = WORDS.findall(text.lower())
            if not words:
                continue
            hashes = _hashes(words)
            size = 1 << (len(hashes) - 1).bit_length()
            self.classes.add(size)
            self.exact[name] = frozenset(shingles(words))
            for band, low in enumerate(self._signature(hashes).tolist()):
                self.bands.setdefault((size, band, low), []).append(name)
            every.append(hashes)
        self.known = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.known >> np.uint64(64 - TABLE_BITS)] = True

    def _signature(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes[None, :] * self.mul[:, None] + self.add[:, None]).min(axis=1)

    def windows(self, size: int, at: np.ndarray, n: int) -> list[tuple[int, int]]:
        """Windows (start, end) of class ``size`` over n shingles that hold one of the places ``at``."""
        step, width = (size // 4, size + size // 4) if size >= 4 else (1, size)
        last = max(0, -(-(n - width) // step))
        starts = {s for p in at.tolist() for s in range(max(0, -(-(p - width + 1) // step)), min(last, p // step) + 1)}
        return [(s * step, min(n, s * step + width)) for s in sorted(starts)]

    def matches(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, first word, words, containment) in order of template and place."""
        words = WORDS.findall(text.lower())
        hashes = _hashes(words)
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - TABLE_BITS)])
        at = at[np.isin(hashes[at], self.known)]
        if not len(at):
            return []
        found: dict[str, list[list]] = {}
        for size in sorted(self.classes):
            for a, b in self.windows(size, at, len(hashes)):
                names = {n for band, low in enumerate(self._signature(hashes[a:b]).tolist()) for n in self.bands.get((size, band, low), ())}
                if not names:
                    continue
                own = shingles(words[a : b + SHINGLE - 1])
                for name in names:
                    want = self.exact[name]
                    share = len(want.intersection(own)) / len(want)
                    if share >= self.least:
                        places = [a + i for i, s in enumerate(own) if s in want]
                        found.setdefault(name, []).append([places[0], min(len(words), places[-1] + SHINGLE), share])
        out = []
        for name, own in sorted(found.items()):
            merged: list[list] = []
            for a, b, share in sorted(own):
                if merged and a < merged[-1][1]:
                    merged[-1] = [merged[-1][0], max(b, merged[-1][1]), max(share, merged[-1][2])]
                else:
                    merged.append([a, b, share])
            out += [(name, a, b - a, share) for a, b, share in merged]
        return out


@lru_cache(4)
def _scanner(templates: tuple[tuple[str, str], ...], least: float) -> Scanner:
    return Scanner(dict(templates), least)


def template_table(rows: DataFrame, most: int = 10_000) -> dict[str, str]:
    """Templates of a table (name, text), at most ``most`` of them: what ``scan`` takes for further licences, whole texts or notices. Null names and texts are left out."""
    found = rows.where("name is not null and text is not null").select("name", "text").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("too many templates")
    return {r.name: r.text for r in found}


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, matches) for each row; matches are (template, first, words, containment)."""
    fixed = tuple(sorted(templates.items()))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = _scanner(fixed, least)
        found = [[{"template": n, "first": a, "words": w, "containment": s} for n, a, w, s in scanner.matches((t or b"").decode("utf-8", "replace"))] for t in raw(batch.column(1))]
        kind = pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "matches"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, "id long, matches array<struct<template: string, first: long, words: long, containment: double>>")


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences that the text of each row of ``documents`` holds, with first word, words and containment; defined cases as in the module's docstring."""
    found = scan(table(spark, sf_dir, "documents"))
    line = F.transform("matches", lambda m: F.concat(m["template"], F.lit("@"), m["first"], F.lit("+"), m["words"], F.lit(":"), F.round(m["containment"], 4)))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["template"])))
    return found.select(F.col("id").alias("doc_id"), F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.array_join(line, ";").alias("matches"))
