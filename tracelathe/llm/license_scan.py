"""License scans by patience alignment with templates.

Words are runs of letters, digits and signs outside ASCII, A-Z lower-cased. A template is found where an alignment
covers at least `cover` of its words and the matched words make up at least `dense` of the words they span.

The alignment anchors on words that occur once in the template's part and once in the text's part, takes the
longest increasing subsequence of these anchors, and aligns the gaps between them in the same way; where no such
word is left, equal words at the gap's two ends are matched, and words that repeat in the text are taken nearest
to where the template has them.

Where to align: at most n - ceil(cover * n) of a template's n words may be missing, so of any one word more than
that one must be there. The template's words that are rarest in the document are taken for these, and each of their
places gives two windows: one that the whole template fits in with a quarter of its length to spare, and one with as
many words to spare on either side as `dense` lets stand between matched ones. Documents that lack too many of a
template's words are passed over for it. Neither step leaves out a place. Matched words at the ends that make a match
too thin are dropped as long as enough are left. Of overlapping matches the one
with more matched words stays (then higher coverage, smaller place, smaller name).

Null and empty texts and texts without words match nothing; templates without words are ignored; rows that repeat
are scanned each; an empty table has an empty result; other columns are ignored. Texts may be of any length.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracelathe.llm.columns import ALNUM, LOWER, by_batch, only, run_hashes, text_bytes, word_runs

COVER = 0.8
DENSE = 0.6

#: Notices as licences prescribe or projects commonly word them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def _hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and where each text's begin."""
    data, at = text_bytes(texts)
    data = LOWER[data]
    begin, end = word_runs(data, at, ALNUM)
    return run_hashes(data, begin, end), np.searchsorted(begin, at)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence with increasing second members of pairs in order of their first."""
    tops, backs, ends = [], [], []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        backs.append(ends[k - 1] if k else -1)
        tops[k : k + 1] = [y]
        ends[k : k + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = backs[i]
    return out[::-1]


def patience(template: list[int], text: list[int]) -> list[tuple[int, int]]:
    """Matched places (in the template, in the text), both increasing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(template), 0, len(text))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and template[a] == text[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once: dict[int, int] = {}
        for i in range(a, b):
            once[template[i]] = -1 if template[i] in once else i
        where: dict[int, list[int]] = {}
        for j in range(c, d):
            if once.get(text[j], -1) >= 0:
                where.setdefault(text[j], []).append(j)
        anchors = [(once[w], js[0]) for w, js in where.items() if len(js) == 1]
        if not anchors:  # repeated in the text: the place that is nearest to the template's
            anchors = [(once[w], min(js, key=lambda j: abs((j - c) - (once[w] - a)))) for w, js in where.items()]
        if not anchors:
            continue
        left, right = a, c
        for i, j in [*_increasing(sorted(anchors)), (b, d)]:
            if i < b:
                out.append((i, j))
            todo.append((left, i, right, j))
            left, right = i + 1, j + 1
    return sorted(out)


class Templates:
    def __init__(self, templates: dict[str, str], cover: float, dense: float):
        self.cover, self.dense = cover, dense
        words, at = _hashes(pa.array(templates.values(), pa.large_string()))
        self.names, self.words = [], []
        for name, a, b in zip(templates, at.tolist(), at[1:].tolist(), strict=False):
            if b > a:
                self.names.append(name)
                self.words.append(words[a:b].tolist())
        self.all = np.unique(words)
        number = {w: i for i, w in enumerate(self.all.tolist())}
        self.has = np.zeros((len(self.all), len(self.names)), np.int32)
        for t, own in enumerate(self.words):
            self.has[[number[w] for w in own], t] = [own.count(w) for w in own]
        # Words that may be missing: as many as coverage allows, each place of a template counting.
        self.need = np.array([int(np.ceil(cover * len(x))) for x in self.words], np.int32)

    def windows(self, t: int, where: dict[int, list[int]], n: int) -> set[tuple[int, int]]:
        own = self.words[t]
        spares = (len(own) // 4 + 3, max(len(own) // 4 + 3, int(np.ceil(len(own) / self.dense)) - len(own)))
        rare = sorted(range(len(own)), key=lambda i: len(where.get(own[i], ())))[: len(own) - int(self.need[t]) + 1]
        return {(max(0, p - i - spare), min(n, p - i + len(own) + spare)) for spare in spares for i in rare for p in where.get(own[i], ())}

    def matches(self, t: int, windows, text: list[int]) -> list[tuple[int, float, int, int, str]]:
        own, found = self.words[t], []
        for a, b in windows:
            pairs = patience(own, text[a:b])
            while len(pairs) > self.need[t] and len(pairs) < self.dense * (pairs[-1][1] - pairs[0][1] + 1):
                pairs = pairs[1:] if pairs[1][1] - pairs[0][1] > pairs[-1][1] - pairs[-2][1] else pairs[:-1]
            if len(pairs) >= self.need[t]:
                first, last = a + pairs[0][1], a + pairs[-1][1]
                if len(pairs) >= self.dense * (last - first + 1):
                    found.append((len(pairs), len(pairs) / len(own), first, last, self.names[t]))
        return found

    def scan(self, words: np.ndarray, at: np.ndarray):
        """(text, name, first word, last word, matched, coverage) of every match in a batch."""
        place = np.minimum(np.searchsorted(self.all, words), len(self.all) - 1)
        known = np.flatnonzero(self.all[place] == words)
        doc = np.searchsorted(at, known, "right") - 1
        present = np.zeros((len(at) - 1, len(self.all)), np.int32)
        present[doc, place[known]] = 1
        worth = present @ self.has >= self.need
        for d in np.flatnonzero(worth.any(axis=1)).tolist():
            text = words[at[d] : at[d + 1]].tolist()
            where: dict[int, list[int]] = {}
            for i in known[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")].tolist():
                where.setdefault(int(words[i]), []).append(i - int(at[d]))
            found = [m for t in np.flatnonzero(worth[d]).tolist() for m in self.matches(t, self.windows(t, where, len(text)), text)]
            for matched, coverage, first, last, name in best(found):
                yield d, name, first, last, matched, coverage


def best(found: list[tuple[int, float, int, int, str]]) -> list[tuple[int, float, int, int, str]]:
    """The matches left when each gives way to better ones that it overlaps, in order of place."""
    kept: list[tuple[int, float, int, int, str]] = []
    firsts: list[int] = []
    for m in sorted(set(found), key=lambda m: (-m[0], -m[1], m[2], m[3], m[4])):
        k = bisect_left(firsts, m[2])  # matches kept don't overlap, so only the neighbours can be in the way
        if (k == 0 or kept[k - 1][3] < m[2]) and (k == len(kept) or kept[k][2] > m[3]):
            kept.insert(k, m)
            firsts.insert(k, m[2])
    return kept


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, cover: float = COVER, dense: float = DENSE, doc_id="doc_id", text="text") -> DataFrame:
    """One row per match: doc_id, license, first_word, last_word (from 0), n_matched and coverage."""
    own = Templates(templates or TEMPLATES, cover, dense)
    held = docs.sparkSession.sparkContext.broadcast(own)  # the templates

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not held.value.names:
            return None
        rows = list(held.value.scan(*_hashes(batch.column(1))))
        if not rows:
            return None
        d, name, first, last, matched, coverage = zip(*rows, strict=True)
        ids = batch.column(0).take(pa.array(d))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(name), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(matched, pa.int64()), pa.array(coverage, pa.float64())],
            names=["doc_id", "license", "first_word", "last_word", "n_matched", "coverage"],
        )

    return only(docs, doc_id=doc_id, text=text).mapInArrow(by_batch(work), "doc_id bigint, license string, first_word bigint, last_word bigint, n_matched bigint, coverage double")
