"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template of m shingles is looked for in windows of two adjacent blocks of b shingles, laid from the beginning of each text
and overlapping by a block; b is the least power of two from m + m // 4 on, so any m + m // 4 consecutive shingles lie in one
window.  A window that holds a share c of the template has a similarity of at least c * m / (2 * b + (1 - c) * m), more than
0.14 for c = 0.75 (b < 2 * (m + m // 4)); with 64 bands of one minhash it is retrieved with a probability of at least
1 - (1 - 0.14)**64 > 0.9999.

Where a window retrieves a template, all copies in that text are found exactly.  A copy is a stretch of at most m + m // 4
shingles that holds a share c of the template's: the one with the most of them counts, then the shortest, then the first;
then the same in what is left before and after it.  So what is found depends on the text alone, not on windows or batches.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, WordHashes, shingles
from .minhash_dedup import hash_family

BANDS = 64
CONTAINMENT = 0.75
#: Shingles of the smallest block; the others are twice, four times, ... as large.
SMALLEST = 4
#: Shingles that are scanned together.
BLOCK = 200_000

#: Notices and characteristic paragraphs of public licences.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "BSL-1.0": ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "WTFPL": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",),
}

_JOINTS = re.compile(rb"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+")


def plain(text: bytes) -> bytes:
    """ASCII punctuation as spaces, so that a full stop or quotes do not hide a notice."""
    return _JOINTS.sub(b" ", text)


def reach(m: int) -> int:
    """The most shingles that a copy of a template of m shingles may stretch over."""
    return m + m // 4


class Templates:
    def __init__(self, templates: dict[str, tuple[str, ...]], bands: int, k: int):
        words, self.k = WordHashes(), k
        self.name, self.sets = [], []
        for name, texts in templates.items():
            for text in texts:
                self.name.append(name)
                self.sets.append(np.unique(shingles(words.of(plain(text.encode())), k)))
        self.a, self.b = hash_family(bands, seed=11)
        by_level = defaultdict(list)
        for t, s in enumerate(self.sets):
            by_level[max(0, (reach(len(s)) - 1).bit_length() - (SMALLEST - 1).bit_length())].append(t)
        self.levels = max(by_level, default=-1) + 1
        #: By level (blocks of SMALLEST << level shingles) and band: minhash to templates, and a bit map over the low 16 bits of those minhashes.
        self.bands: list[list[tuple[dict[int, list[int]], np.ndarray]]] = []
        for level in range(self.levels):
            tables = []
            for a, b in zip(self.a, self.b, strict=True):
                table, bits = defaultdict(list), np.zeros(1 << 16, bool)
                for t in by_level[level]:
                    low = int((self.sets[t] * a + b).min())
                    table[low].append(t)
                    bits[low & 0xFFFF] = True
                tables.append((dict(table), bits))
            self.bands.append(tables)

    def retrieved(self, parts: list[np.ndarray]) -> set[tuple[int, int]]:
        """(index of parts, template) where a window of a part shares a band with a template."""
        sizes = np.array([len(p) for p in parts])
        s, found = np.concatenate(parts), set()
        # By level: where blocks begin among those of the level below, whose they are, and whether the next one is of the same text.
        layout, step = [], SMALLEST
        for _ in range(self.levels):
            blocks = -(-sizes // step)
            owner = np.repeat(np.arange(len(parts)), blocks)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            layout.append((np.repeat(np.cumsum(sizes) - sizes, blocks) + within * step, owner, owner[1:] == owner[:-1]))
            sizes, step = blocks, 2
        for band, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            low = s * a + b
            for level, (starts, owner, paired) in enumerate(layout):
                low = np.minimum.reduceat(low, starts)
                table, bits = self.bands[level][band]
                if table:
                    window = low.copy()
                    np.minimum(window[:-1], low[1:], out=window[:-1], where=paired)
                    for i in np.flatnonzero(bits[window & np.uint64(0xFFFF)]).tolist():
                        for t in table.get(int(window[i]), ()):
                            found.add((int(owner[i]), t))
        return found

    def copies(self, part: np.ndarray, t: int, least: float) -> list[tuple[int, int, int]]:
        """(first word, past the last, template shingles in it) of the copies of a template in a text, by the rule above."""
        wanted, k = self.sets[t], self.k
        at = np.minimum(np.searchsorted(wanted, part), len(wanted) - 1)
        where = np.flatnonzero(wanted[at] == part)
        which, need, most = at[where], least * len(wanted), reach(len(wanted))
        # The occurrence before of the same shingle, by index of where.
        order, before = np.argsort(which, kind="stable"), np.full(len(where), -1)
        again = which[order[1:]] == which[order[:-1]]
        before[order[1:][again]] = order[:-1][again]
        ends = np.searchsorted(where, where + most)

        def stretch(i: int, limit: int | None) -> tuple[int, int, int] | None:
            """(fewer is better: -shingles, length, index) from hit i on, its words ending at limit at most."""
            j = int(ends[i]) if limit is None else min(int(ends[i]), int(np.searchsorted(where, limit - k, "right")))
            first = before[i:j] < i
            n = int(first.sum())
            return (-n, int(where[i + np.flatnonzero(first)[-1]]) + 1 - int(where[i]), i) if n >= need and n else None

        heap = [x for i in np.flatnonzero(ends - np.arange(len(where)) >= need).tolist() if (x := stretch(i, None))]
        heapq.heapify(heap)
        taken: list[tuple[int, int, int]] = []
        while heap:
            n, length, i = heapq.heappop(heap)
            start = int(where[i])
            end, place = start + length - 1 + k, bisect_right(taken, (start, 1 << 62, 0))
            if place and taken[place - 1][1] > start:
                continue
            if place < len(taken) and taken[place][0] < end:
                # What was taken cuts it short: it waits for its turn as what is left of it.
                if shorter := stretch(i, taken[place][0]):
                    heapq.heappush(heap, shorter)
                continue
            insort(taken, (start, end, -n))
        return taken


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, containment: float = CONTAINMENT, bands: int = BANDS, k: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of df: doc_id, matches: array of (license, word_start, word_end, containment) by place.

    Words are runs without ASCII white space and punctuation, A-Z lower-cased; word_end is exclusive.  Where copies of
    several templates overlap (licences share wording) the one with the most template shingles stays.  Null, empty or too
    short texts have no matches; repeated rows and null ids have rows of their own; an empty table gives none.
    templates are broadcast: their number and size are the caller's parameter, not the data's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = WordHashes(), Templates(templates, bands, k)
        for b in batches:
            at = 0
            while at < b.num_rows:
                first, parts, size = at, [], 0
                while at < b.num_rows and (size < BLOCK or at == first):
                    text = b.column(1)[at].as_buffer()
                    w = words.of(plain(text.to_pybytes())) if text else np.zeros(0, np.uint64)
                    # A text of fewer than k words has no full shingle, so it holds no template of k words.
                    parts.append(shingles(w, k) if len(w) >= k else w[:0])
                    size += len(parts[-1])
                    at += 1
                found = matches(known, parts, containment)
                rows = [found.get(i, []) for i in range(len(parts))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, at - first), pa.array(rows, pa.list_(pa.struct([("word_start", pa.int64()), ("word_end", pa.int64()), ("license", pa.string()), ("containment", pa.float64())])))], names=["doc_id", "matches"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, matches array<struct<word_start:bigint,word_end:bigint,license:string,containment:double>>")


def matches(known: Templates, parts: list[np.ndarray], least: float) -> dict[int, list[dict]]:
    """By index of parts (each the shingles of one text) its verified matches, none overlapping another."""
    if not known.sets or not any(map(len, parts)):
        return {}
    found = defaultdict(list)
    for doc, t in known.retrieved(parts):
        found[doc] += [(-n, a, t, b) for a, b, n in known.copies(parts[doc], t, least)]
    out = {}
    for doc, spans in found.items():
        taken: list[tuple[int, int, int, int]] = []
        for n, a, t, b in sorted(spans):
            place = bisect_right(taken, (a, 1 << 62, 0, 0))
            if not (place and taken[place - 1][1] > a) and not (place < len(taken) and taken[place][0] < b):
                insort(taken, (a, b, t, -n))
        out[doc] = [{"word_start": a, "word_end": b, "license": known.name[t], "containment": n / len(known.sets[t])} for a, b, t, n in taken]
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_matches, licenses (distinct names, sorted), spans (license:start:end)."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_sort(F.array_distinct("matches.license"))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["word_start"].cast("string"), m["word_end"].cast("string")))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))
