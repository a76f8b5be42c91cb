"""License scans (operator 1).

Templates are cut into word 3-grams; of every three consecutive ones the least hash is
kept (winnowing) in an inverted index, so any run of five words that a text shares with
a template yields a common fingerprint.  Where enough different fingerprints of a template
lie within reach of each other (``REACH`` times its words, more than any alignment spans),
a local alignment of words over the whole of that reach gives how many words of the
template are matched, and where, however many words stand between them as long as they
cost less than the match on either side gains.  What is left before and after it is aligned
again until no fingerprints are left.

A match of less than ``MIN_COVERAGE`` of the template is a part: it is reported, with its
coverage, if it has the share of words that makes a candidate and ``LEAST_WORDS`` words.

The index holds the templates only, whose number is a parameter; no text is shuffled.
Defined results: a null or wordless text has no match; a template without words is never matched;
of overlapping matches a whole one stays before a part, then the one of more matched words (then the higher coverage,
then the name first in order); repeated rows are reported each.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowmap import free_name, map_texts
from .decontaminate import winnow
from .words import Words, find_sorted, inside_text, ngram_hashes, word_slices

GRAM, SPAN, REACH, MIN_COVERAGE, MIN_PRINTS = 3, 3, 3, 0.8, 0.3
LEAST_WORDS = GRAM + SPAN - 1
MATCH, MISMATCH, GAP = 2, -1, -1

# Public license notices.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT line": "Released under the MIT License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
}


@dataclass(frozen=True)
class Match:
    license: str
    coverage: float
    matched: int
    start: int
    end: int


def rows(text: np.ndarray, template: np.ndarray) -> Iterator[np.ndarray]:
    """For each word of the template, the best scores of local alignments that end there and at each word of the text (from 1 on)."""
    place = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for word in template:
        made = np.maximum(row + GAP, 0)
        made[1:] = np.maximum(made[1:], row[:-1] + np.where(text == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(made - GAP * place) + GAP * place
        yield row


def best_end(text: np.ndarray, template: np.ndarray) -> int:
    """End of the best local alignment, 0 if there is none; of equal ones, that nearest to the middle of the text."""
    top = np.zeros(len(text) + 1, dtype=np.int64)
    for row in rows(text, template):
        np.maximum(top, row, out=top)
    if not top.any():
        return 0
    ends = np.flatnonzero(top == top.max())
    return int(ends[np.abs(ends - len(text) // 2).argmin()])


def align(text: np.ndarray, template: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, end) of the best local alignment of the template with the words of the text from ``shift - band``
    to ``shift + band`` and the template's length; (0, 0, 0) if nothing is matched."""
    low = max(0, shift - band)
    text = text[low : max(low, shift + len(template) + band)]
    score = np.array([np.zeros(len(text) + 1, dtype=np.int64), *rows(text, template)])
    i, j = np.unravel_index(score.argmax(), score.shape)
    matched = first = end = 0
    while score[i, j]:
        same = i and j and text[j - 1] == template[i - 1]
        if i and j and score[i, j] == score[i - 1, j - 1] + (MATCH if same else MISMATCH):
            i, j = i - 1, j - 1
            if same:
                matched, first, end = matched + 1, int(j), end or int(j) + 1
        elif i and score[i, j] == score[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return (matched, low + first, low + end) if matched else (0, 0, 0)


class TemplateIndex:
    """Inverted index of the templates' winnowed fingerprints."""

    def __init__(self, templates: Mapping[str, str]):
        self.names, self.words, postings = [], [], defaultdict(list)
        for name, text in sorted(templates.items()):
            words = Words(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text.encode())]))
            if not len(words.hash):
                continue
            prints = self._prints(words)
            for p, h in prints:
                postings[h].append((len(self.names), p))
            self.names.append(name)
            self.words.append(words.hash)
        self.keys = np.array(sorted(postings), dtype=np.uint64)
        self.postings = [postings[int(k)] for k in self.keys]
        self.prints = [0] * len(self.names)
        for found in self.postings:
            for t, _ in found:
                self.prints[t] += 1

    @staticmethod
    def _prints(words: Words) -> list[tuple[int, int]]:
        """Winnowed 3-grams; a template of fewer than five words has all of its n-grams."""
        n = min(GRAM, len(words.hash))
        grams = ngram_hashes(words.hash, n)
        kept = winnow(grams, np.ones(len(grams), dtype=bool), SPAN) if len(grams) >= SPAN else np.arange(len(grams))
        return [(int(p), int(grams[p])) for p in kept]

    def scan(self, words: Words, least: float = MIN_COVERAGE) -> list[list[Match]]:
        """The matches in each text, spans in words of the text."""
        of = words.text_of_word()
        out: list[list[Match]] = [[] for _ in range(len(words.first) - 1)]
        prints: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for n in range(1, GRAM + 1):
            grams = ngram_hashes(words.hash, n)
            where = np.flatnonzero(inside_text(of, n))
            if n < GRAM and not any(len(w) == n for w in self.words):
                continue
            hit, at = find_sorted(self.keys, grams[where])
            for p, k in zip(where[hit].tolist(), at.tolist(), strict=True):
                for t, q in self.postings[k]:
                    prints[int(of[p]), t].append((p - int(words.first[of[p]]), q))
        for (i, t), found in prints.items():
            out[i] += self._matches(words.hash[words.first[i] : words.first[i + 1]], t, sorted(found), least)
        return [apart(m, least) for m in out]

    def _matches(self, text: np.ndarray, t: int, found: list[tuple[int, int]], least: float) -> Iterator[Match]:
        """Matches of template t that do not overlap; ``found`` are (place in the text, place in the template) of fingerprints."""
        template = self.words[t]
        reach, gram = REACH * len(template), min(GRAM, len(template))
        todo = [(0, len(text), found)]
        while todo:
            low, high, found = todo.pop()
            a = 0
            for b in range(1, len(found) + 1):
                if b < len(found) and found[b][0] - found[b - 1][0] <= reach:
                    continue
                group, a = found[a:b], b
                if len({q for _, q in group}) < MIN_PRINTS * self.prints[t]:
                    continue
                lo, hi = max(low, group[0][0] - reach), min(high, group[-1][0] + gram + reach)
                end = lo + best_end(text[lo:hi], template)
                matched, first, end = align(text[lo:end], template, end - lo - 2 * len(template), len(template))
                if not matched:  # equal hashes of different words
                    continue
                first, end = lo + first, lo + end
                coverage = matched / len(template)
                if coverage >= least or (matched >= LEAST_WORDS and coverage >= MIN_PRINTS):
                    yield Match(self.names[t], coverage, matched, first, end)
                todo.append((lo, first, [x for x in group if x[0] + gram <= first]))
                todo.append((end, hi, [x for x in group if x[0] >= end]))


def apart(matches: list[Match], least: float = MIN_COVERAGE) -> list[Match]:
    """Matches that do not overlap, whole ones and then the better ones first chosen; in order of place."""
    kept: list[Match] = []
    starts: list[int] = []
    for m in sorted(set(matches), key=lambda m: (m.coverage < least, -m.matched, -m.coverage, m.license, m.start)):
        k = bisect(starts, m.start)
        if (k == 0 or kept[k - 1].end <= m.start) and (k == len(kept) or m.end <= starts[k]):
            kept.insert(k, m)
            starts.insert(k, m.start)
    return kept


MATCHES = T.ArrayType(T.StructType([
    T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("matched", T.LongType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()),
]))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, *, text: str = "text", keep: Sequence[str] = ("doc_id",), least: float = MIN_COVERAGE) -> DataFrame:
    """One row per match: ``keep`` columns, license, coverage (share of the template's words matched, in order),
    matched words, and the span in words (start, end) and characters (start_char, end_char)."""
    shared = docs.sparkSession.sparkContext.broadcast(dict(templates))

    def factory():
        index = TemplateIndex(shared.value)

        def mapper(column: pa.Array) -> list[pa.Array]:
            rows = []
            for _, _, words in word_slices(column):
                for i, found in enumerate(index.scan(words, least=least)):
                    base, first = int(words.text_start[i]), int(words.first[i])
                    chars = lambda byte: int(((words.folded[base:byte] & 0xC0) != 0x80).sum())  # noqa: E731, B023
                    rows.append([{"license": m.license, "coverage": m.coverage, "matched": m.matched, "start": m.start, "end": m.end, "start_char": chars(int(words.start[first + m.start])), "end_char": chars(int(words.end[first + m.end - 1]))} for m in found])
            kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64())]))
            return [pa.array(rows, kind)]

        return mapper

    name = free_name(docs.select(*keep), "found")
    found = map_texts(docs, factory, [T.StructField(name, MATCHES)], text, keep)
    return found.select(*keep, F.explode(name).alias("m")).select(*keep, "m.*")
