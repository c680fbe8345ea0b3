"""Licence scans by a positional rare-token index."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_class, text_slices, words

# Fixed values: (label, words of the template, mandatory key phrase).
TEMPLATES = (
    ("cc-by", "cc by", "cc by"),
    ("gpl", "general public license", "general public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
)
# Fixed values: (label, mandatory key phrase, text of the licence or of its notice).
TEXTS = (
    (
        "mit",
        "to deal in the software without restriction",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        "with or without fee is hereby granted",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd-3-clause",
        "neither the name of",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name
of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    ),
    (
        "zlib",
        "altered source versions must be plainly marked as such",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "apache-2.0",
        "licensed under the apache license",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License
at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
    ),
    (
        "gpl-3.0",
        "either version 3 of the license",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    (
        "unlicense",
        "released into the public domain",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either
in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
)
#: The labels whose every place counts as a base place; their templates must match whole.
BASE = ("cc-by", "gpl", "reserved")
COVERAGE = 0.7
#: Words of a clause, in which a text is looked for, and by how many words the clauses of one place may be displaced together.
CLAUSE, DRIFT = 8, 48
#: Bytes between words, once A-Z is lower-cased: [\x00-\x2F\x3A-\x60\x7B-\x7F].
GAP = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def _hash_words(texts: Sequence[str]) -> np.ndarray:
    data = "\n".join(texts).encode()
    return words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), GAP)[0]


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


class Index:
    """Postings of the templates' words: which template has them, and where in it.

    Templates from `clause` on are the clauses of texts: `of` says of which text, `at` where in it. The key phrase of a text is a template
    that has to match whole, the last one of its own.
    """

    def __init__(self, templates: Sequence[tuple[str, str, str]] = TEMPLATES, texts: Sequence[tuple[str, str, str]] = TEXTS):
        self.clause = len(templates)
        templates = list(templates)
        self.of, self.at, self.texts = [-1] * self.clause, [0] * self.clause, []
        for k, (label, key, text) in enumerate(texts):
            w, key_words = _words(text), _words(key)
            cuts = list(range(0, max(1, len(w) - CLAUSE // 2), CLAUSE)) + [len(w)]
            self.texts.append((label, len(w), next(i for i in range(len(w)) if w[i : i + len(key_words)] == key_words)))
            for a, b in itertools.pairwise(cuts):
                templates.append((label, " ".join(w[a:b]), w[a]))
                self.of.append(k)
                self.at.append(a)
            templates.append((label, " ".join(key_words), " ".join(key_words)))
            self.of.append(k)
            self.at.append(-1)
        self.names = sorted({w for _, t, _ in templates for w in t.split()})
        hashes = _hash_words(self.names)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        at = {w: i for i, w in enumerate(self.names)}
        self.labels = [x for x, _, _ in templates]
        self.words = [np.array([at[w] for w in t.split()]) for _, t, _ in templates]
        self.key = []
        for _, t, k in templates:
            t, k = t.split(), k.split()
            self.key.append((next(i for i in range(len(t)) if t[i : i + len(k)] == k), len(k)))
        self.need = [len(w) if x in BASE or a < 0 else math.ceil(COVERAGE * len(w)) for x, w, a in zip(self.labels, self.words, self.at, strict=True)]
        # a clause needs no phrase of its own
        self.key = [(0, 0) if k >= 0 and a >= 0 else key for key, k, a in zip(self.key, self.of, self.at, strict=True)]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Per word its number among the templates' words, or -1."""
        i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[i] == hashes, self.by_hash[i], -1)


def word_documents(docs: DataFrame, index: Index) -> list[int]:
    """For each word of the index, in how many documents of docs (doc_id, text) it stands; all are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.names), dtype=np.int64)
        for batch in batches:
            for _, _, data, rows in text_slices(batch, 0):
                h, _, _, first = words(data, rows, GAP)
                ids = index.ids(h)
                hit = np.flatnonzero(ids >= 0)
                row = np.searchsorted(first, hit, side="right")
                total += np.bincount(np.unique(row * len(index.names) + ids[hit]) % len(index.names), minlength=len(index.names))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["word", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    have = {r["word"]: r["n"] for r in found}
    return [have.get(i, 0) for i in range(len(index.names))]


def _places(index: Index, weights: np.ndarray, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, start word in the row, coverage) of the accepted places of each template, and its number.

    A place must match `need` of a template's words at their relative positions, so it matches one of
    any len - need + 1 of them: the rarest ones are looked up, and give the starts to intersect.
    """
    hit = np.flatnonzero(ids >= 0)
    hit_ids = ids[hit]
    order = np.argsort(hit_ids, kind="stable")
    bounds = np.searchsorted(hit_ids[order], np.arange(len(index.names) + 1))
    for t, seq in enumerate(index.words):
        rare = sorted(range(len(seq)), key=lambda j: (-weights[seq[j]], j))[: len(seq) - index.need[t] + 1]
        cand = []
        for j in rare:
            at = hit[order[bounds[seq[j]] : bounds[seq[j] + 1]]]
            row = np.searchsorted(first, at, side="right") - 1
            start = at - j
            # a place may hang over neither end of its text
            ok = (start >= first[row]) & (start + len(seq) <= first[row + 1])
            cand.append(start[ok])
        start = np.unique(np.concatenate(cand))
        if not len(start):
            continue
        match = np.stack([ids[start + j] == w for j, w in enumerate(seq)], axis=1)
        a, n = index.key[t]
        ok = (match.sum(axis=1) >= index.need[t]) & match[:, a : a + n].all(axis=1)
        start, match = start[ok], match[ok]
        if len(start):
            own = weights[seq] + 1e-9
            row = np.searchsorted(first, start, side="right") - 1
            yield row, start - first[row], np.minimum(match @ own / own.sum(), 1.0), t


def _whole_texts(index: Index, weights: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> Iterator[tuple[int, int, float, int]]:
    """(row, start word, coverage, text) of the places of whole texts, from those of their clauses and key phrases.

    A clause at word x that stands at word a of its text says that the text starts at x - a. Clauses of a text whose starts follow one another
    by at most DRIFT words make a place; each counts once, with the best of its matches. A place needs the key phrase
    near where it belongs, and clauses with COVERAGE of the text's weight.
    """
    per: dict[tuple[int, int], list[tuple[int, int, int, float]]] = {}
    for row, start, share, t in found:
        k = index.of[t]
        if k >= 0:
            at = index.at[t] if index.at[t] >= 0 else index.texts[k][2]
            for r, x, s in zip(row.tolist(), start.tolist(), share.tolist(), strict=True):
                per.setdefault((r, k), []).append((x - at, x, t, s))
    total = [0.0] * len(index.texts)
    for t, k in enumerate(index.of):
        if k >= 0 and index.at[t] >= 0:
            total[k] += float((weights[index.words[t]] + 1e-9).sum())
    for (row, k), hits in sorted(per.items()):
        hits.sort()
        cuts = [0, *(i for i in range(1, len(hits)) if hits[i][0] - hits[i - 1][0] > DRIFT), len(hits)]
        for a, b in itertools.pairwise(cuts):
            best: dict[int, float] = {}
            for _, _, t, s in hits[a:b]:
                best[t] = max(best.get(t, 0.0), s)
            share = sum(s * float((weights[index.words[t]] + 1e-9).sum()) for t, s in best.items() if index.at[t] >= 0) / total[k]
            if share >= COVERAGE and any(index.at[t] < 0 for t in best):
                yield row, min(x for _, x, t, _ in hits[a:b] if index.at[t] >= 0), min(share, 1.0), k


def license_places(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, texts: Sequence[tuple[str, str, str]] = TEXTS) -> DataFrame:
    """doc_id, n_words, places (label, start, length, coverage) for every row of docs (doc_id, text).

    Words are runs of a-z, 0-9 and bytes above 0x7F after lower-casing A-Z. Each template is found by its
    words of highest inverse document frequency, counted over all of docs: the postings of these give
    the starts where its other words are then compared by relative position. A place needs its mandatory
    key phrase and 70 % of the words (all of them for the base labels). coverage weighs the words
    that match by that frequency. Whole licence texts are looked for by clauses of 8 words in the same way: clauses that stand where
    one start of the text would put them, give or take a name or a line put in, make a place if they have 70 % of its weight and
    the key phrase is there. Places lie within one text.

    Edge cases: null and empty texts have no words and no places; overlapping and repeated places all
    count; repeated rows and null doc_ids are scanned row by row; other columns are ignored; an empty
    table gives an empty result.
    """
    index = Index(templates, texts)
    counts = np.array(word_documents(docs, index), dtype=float)
    weights = np.log1p(max(counts.max(initial=0), 1) / (counts + 1))

    labels = [*index.labels, *(x for x, _, _ in index.texts)]
    sizes = [*map(len, index.words), *(n for _, n, _ in index.texts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, rows in text_slices(batch, 1):
                h, _, _, first = words(data, rows, GAP)
                found = list(_places(index, weights, index.ids(h), first))
                whole = list(_whole_texts(index, weights, found))
                found = [x for x in found if x[3] < index.clause]
                found += [(np.array([r]), np.array([x]), np.array([s]), len(index.labels) + k) for r, x, s, k in whole]
                row = np.concatenate([x[0] for x in found]) if found else np.zeros(0, dtype=np.int64)
                start = np.concatenate([x[1] for x in found]) if found else row
                share = np.concatenate([x[2] for x in found]) if found else row.astype(float)
                which = np.concatenate([np.full(len(x[0]), x[3]) for x in found]) if found else row
                order = np.lexsort((which, start, row))
                at = np.searchsorted(row[order], np.arange(hi - lo + 1))
                which = which[order]
                place = pa.StructArray.from_arrays(
                    [pa.array([labels[i] for i in which], type=pa.string()), pa.array(start[order]), pa.array([sizes[i] for i in which], type=pa.int64()), pa.array(share[order])],
                    ["label", "start", "length", "coverage"],
                )
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), place)], ["doc_id", "n_words", "places"])

    schema = "doc_id long, n_words long, places array<struct<label:string,start:long,length:long,coverage:double>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
