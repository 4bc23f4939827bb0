"""Licence scans: winnowed fingerprints in an inverted index, then banded alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8
from .words import Words

# Notices and the common opening or body of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT-body", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
CHUNK = 1 << 17


def winnow(grams: np.ndarray, edges: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash (rightmost of equals) of every `window` consecutive grams of a text; all of a shorter text's one least."""
    kept = []
    n = len(grams)
    if n:
        place = np.arange(n)
        best = place.copy()
        for k in range(1, window):
            other = np.minimum(place + k, n - 1)
            take = grams[other] <= grams[best]
            best = np.where(take, other, best)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a >= window:
                kept.append(best[a : b - window + 1])
            elif b > a:
                kept.append(np.array([a + int(np.argmin(grams[a:b]))]))
    return np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, last+1) of the best alignment of the template with `words` near one diagonal.

    words[i + shift + d] may stand beside template[i] for |d| <= band. Longest common subsequence by rows of the band;
    of equal scores the shortest stretch of words wins.
    """
    m, n, width = len(template), len(words), 2 * band + 1
    none = (0, 0, 0)
    row: list[tuple[int, int, int]] = [none] * width  # best ending at or before this cell: (matched, -first, last)
    for i in range(m):
        new = []
        for d in range(width):
            j = i + shift + d - band
            best = row[d + 1] if d + 1 < width else none
            if d and new[d - 1] > best:
                best = new[d - 1]
            if 0 <= j < n and words[j] == template[i]:
                score, first, _ = row[d]
                got = (score + 1, first if score else -j, j + 1)
                if got[0] > best[0] or got[0] == best[0] and got[1] - got[2] > best[1] - best[2]:
                    best = got
            new.append(best)
        row = new
    top = max(row, key=lambda x: (x[0], x[1] - x[2]))
    return top[0], -top[1], top[2]


class Index:
    def __init__(self, templates, gram: int, window: int):
        self.names, self.gram, self.window = [t[0] for t in templates], gram, window
        self.words = [Words([utf8(t[1])]).hash for t in templates]
        post: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(templates):
            w = Words([utf8(t[1])])
            g, first, edges = w.shingles(gram)
            for at in winnow(g, edges, window).tolist():
                post.setdefault(int(g[at]), []).append((k, int(first[at])))
        self.post = post
        self.prints = np.array(sorted(post), np.uint64)

    def scan(self, texts: list[bytes], band: int, cover: float):
        """(text, template, matched, start byte, end byte) with at least `cover` of the template matched; the best place first per diagonal band."""
        words = Words(texts)
        g, first, edges = words.shingles(self.gram)
        kept = winnow(g, edges, self.window)
        hit = kept[np.isin(g[kept], self.prints)]
        spots: dict[tuple[int, int], list[int]] = {}
        text = np.searchsorted(edges, hit, "right") - 1
        for at, t in zip(hit.tolist(), text.tolist()):
            for k, i in self.post[int(g[at])]:
                spots.setdefault((t, k), []).append(int(first[at]) - i)
        found = []
        for (t, k), shifts in sorted(spots.items()):
            a, b = int(words.word_edge[t]), int(words.word_edge[t + 1])
            done, last = [], None
            wide = max(1, min(band, len(self.words[k]) // 4))
            for s in sorted(shifts):
                if last is not None and s - last <= wide:
                    continue
                last = s
                low = max(a, s - wide)
                high = min(b, s + len(self.words[k]) + wide)
                done = [span for span in done if span[1] > low]  # later places cannot overlap the others
                n, x, y = align(self.words[k], words.hash[low:high], s - low, wide)
                if n >= cover * len(self.words[k]) and all(low + x >= e or low + y <= f for f, e in done):
                    done.append((low + x, low + y))
                    found.append((t, k, n, int(words.start[low + x] - words.edge[t]), int(words.end[low + y - 1] - words.edge[t])))
        return found


def scan_licenses(docs: DataFrame, templates=TEMPLATES, gram: int = 3, window: int = 2, band: int = 8, cover: float = 0.8) -> DataFrame:
    """Licence templates in the texts of `docs` (doc_id, text): doc_id, license, matched, coverage, start, end.

    Templates and texts are split at white space, ASCII case ignored, into grams of `gram` words, of which winnowing
    keeps the least of every `window`: any stretch of gram + window - 1 words in common shares a kept gram. The templates' grams form an
    inverted index, at most a few thousand entries; texts whose kept grams hit it are aligned with the template in a
    band of `band` words (a quarter of the template's, if that is less) about the hit's diagonal, and stretches that match `cover` of its words are reported with
    their place in UTF-8 bytes. A template may be found several times in a text; texts are scanned whole. Null and
    empty texts have none; repeated rows repeat; an empty table gives an empty result; other columns are ignored.
    """
    content = docs.sparkSession.sparkContext.broadcast(tuple(templates))
    names = ["doc_id", "license", "matched", "coverage", "start", "end"]

    def run(batches):
        index = Index(content.value, gram, window)
        for batch in batches:
            ids, bodies = batch.column(0).to_pylist(), [utf8(t.as_py()) for t in batch.column(1)]
            rows, begin, size = [], 0, 0
            for k in range(len(bodies) + 1):
                if k > begin and (k == len(bodies) or size >= CHUNK):
                    rows += [(ids[begin + t], index.names[m], n, n / len(index.words[m]), a, b) for t, m, n, a, b in index.scan(bodies[begin:k], band, cover)]
                    begin, size = k, 0
                if k < len(bodies):
                    size += len(bodies[k])
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, license string, matched long, coverage double, start long, end long")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
