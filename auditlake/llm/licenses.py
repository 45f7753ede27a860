"""Operator 9: licence scans with a generalised suffix automaton.

The automaton holds the words of all licence templates. A text is streamed through it, which
gives at each word the longest match that ends there and where it stands in the templates. Long
matches in the same order in text and template, with small gaps, are chained; a chain that
covers enough of a template labels the text and gives the span. Short notices, which differ in a
word or two, label only where they stand whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LEAST = 4  # words of a match that counts
GAP = 12  # words that may lie between two matches of a chain
COVERED = 0.6  # share of a template that labels a text

# Phrases of the base scan and public licence notices.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version.""",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "copyright-reserved": "Copyright. All rights reserved.",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means.""",
}
# Short notices as the licences' publishers and SPDX write them, without what stands before "under".
NOTICES = {
    "mit": ["under the MIT License", "under an MIT License", "under the terms of the MIT License", "under MIT License",
            "SPDX-License-Identifier: MIT", "opensource.org/licenses/MIT"],
    "bsd": ["under the BSD License", "under a BSD-style license", "governed by a BSD-style license", "under the BSD 2-Clause License",
            "under the BSD 3-Clause License", "under the 2-Clause BSD License", "under the 3-Clause BSD License", "under the New BSD License",
            "under the Simplified BSD License", "SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause"],
    "apache": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache License v2.0", "the Apache 2.0 License",
               "under the Apache License", "under Apache License 2.0", "under Apache 2.0", "SPDX-License-Identifier: Apache-2.0",
               "www.apache.org/licenses/LICENSE-2.0"],
    "isc": ["under the ISC License", "under the terms of the ISC License", "SPDX-License-Identifier: ISC"],
    "gpl-3": ["under the GNU General Public License, version 3", "under the GNU General Public License v3", "under the GNU GPL version 3",
              "under the GNU GPLv3", "under the GPLv3", "under the GPL, version 3", "under the terms of the GNU General Public License, version 3",
              "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl-2": ["under the GNU General Public License, version 2", "under the GNU General Public License v2", "under the GNU GPL version 2",
              "under the GNU GPLv2", "under the GPLv2", "under the GPL, version 2", "under the terms of the GNU General Public License, version 2",
              "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "lgpl": ["under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License", "under the LGPL"],
    "agpl": ["under the GNU Affero General Public License", "under the terms of the GNU Affero General Public License", "under the AGPL"],
    "mpl": ["the Mozilla Public License, v. 2.0", "the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0",
            "under the Mozilla Public License", "under the MPL 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense": ["under the Unlicense", "released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "cc-by-4": ["under a Creative Commons Attribution 4.0", "under the Creative Commons Attribution 4.0", "under CC BY 4.0",
                "SPDX-License-Identifier: CC-BY-4.0", "creativecommons.org/licenses/by/4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike", "under CC BY-SA", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial", "under CC BY-NC", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc0": ["under CC0", "under the CC0", "CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
}


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(LOWER))


class Automaton:
    """Suffix automaton of several sequences of numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # sequence and place behind each occurrence
        for k, sequence in enumerate(sequences):
            last = 0
            for i, c in enumerate(sequence):
                last = self._add(last, c)
                self.ends[last].add((k, i + 1))
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of exactly the words of p and c, parted from longer ones if need be."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, c)
        return new

    def matches(self, stream: list[int]) -> Iterator[tuple[int, int, int]]:
        """end, length and state of every match that the next word does not lengthen."""
        state = length = 0
        step, link, lengths = self.next, self.link, self.length
        for i, c in enumerate(stream):
            to = step[state].get(c)
            if to is None:
                if length >= LEAST:
                    yield i, length, state
                while to is None and state:
                    state = link[state]
                    length = lengths[state]
                    to = step[state].get(c)
            if to is None:
                length = 0
            else:
                state = to
                length += 1
        if length >= LEAST:
            yield len(stream), length, state


class Scanner:
    def __init__(self, templates: Mapping[str, str], phrases: Mapping[str, str], notices: Mapping[str, Sequence[str]]):
        self.labels = list(templates)
        texts = [words_of(t) for t in templates.values()]
        parts = [(words_of(p), label) for p, label in phrases.items()]
        self.code: dict[str, int] = {}
        for ws in [*texts, *[p for p, _ in parts]]:
            for w in ws:
                self.code.setdefault(w, len(self.code) + 1)
        coded = [[self.code[w] for w in ws] for ws in texts]
        self.sizes = [len(c) for c in coded]
        self.phrases = [([self.code[w] for w in p], label) for p, label in parts if p]
        self.automaton = Automaton(coded)
        self.top = len(self.code)  # words behind it stand in notices only
        short = [([self.code.setdefault(w, len(self.code) + 1) for w in words_of(n)], label) for label, ns in notices.items() for n in ns]
        common = Counter(c for n, _ in short for c in n)
        self.notices: dict[int, list[tuple[list[int], int, str]]] = {}  # by the word that the fewest of them hold
        for n, label in short:
            if n:
                at = min(range(len(n)), key=lambda i: common[n[i]])
                self.notices.setdefault(n[at], []).append((n, at, label))

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, bool, int, int, float]]]:
        """Number of words, and label, whether it is a phrase, first word, word behind and covered
        share of each place found."""
        words = words_of(text)
        codes = np.fromiter(map(self.code.get, words, repeat(0)), np.int32, len(words))
        found = []
        for phrase, label in self.phrases:
            n = len(codes) - len(phrase) + 1
            if n > 0:
                hit = codes[:n] == phrase[0]
                for j in range(1, len(phrase)):
                    hit &= codes[j:j + n] == phrase[j]
                found += [(label, True, i, i + len(phrase), 1.0) for i in np.nonzero(hit)[0].tolist()]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (codes > 0) & (codes <= self.top), [0]])))
        chains: dict[int, list] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < LEAST:
                continue
            for end, length, state in self.automaton.matches(codes[a:b].tolist()):
                for k, place in self.automaton.ends[state]:
                    chains.setdefault(k, []).append((a + end - length, a + end, place - length, place))
        spans = [s for k, matches in chains.items() for s in self._chained(k, sorted(matches))]
        for c in self.notices.keys() & set(codes.tolist()):
            for i in np.flatnonzero(codes == c).tolist():
                for notice, at, label in self.notices[c]:
                    if i >= at and codes[i - at:i - at + len(notice)].tolist() == notice:
                        spans.append((label, False, i - at, i - at + len(notice), 1.0))
        return len(words), sorted(found + self._outer(spans))

    @staticmethod
    def _outer(spans: list[tuple[str, bool, int, int, float]]) -> list[tuple[str, bool, int, int, float]]:
        """Without spans that lie inside another of the same label."""
        out: list[tuple[str, bool, int, int, float]] = []
        for s in sorted(spans, key=lambda s: (s[0], s[2], -s[3], -s[4])):
            if not out or out[-1][0] != s[0] or s[3] > out[-1][3]:
                out.append(s)
        return out

    def _chained(self, k: int, matches: list[tuple[int, int, int, int]]) -> list[tuple[str, bool, int, int, float]]:
        """Best chains of one template: in order on both sides, at most GAP words apart."""
        best: list[tuple[int, int]] = []  # words covered up to here, first word
        low, out, tops, taken = 0, [], [], []  # taken: by place
        for i, (a, b, s, e) in enumerate(matches):
            covered, first = b - a, a
            while low < i and matches[low][0] + self.sizes[k] + GAP < a:
                low += 1
            for j in range(low, i):
                a2, b2, s2, e2 = matches[j]
                over = max(0, b2 - a, e2 - s)
                if a2 < a and s2 < s and b2 < b and e2 < e and a - b2 <= GAP and s - e2 <= GAP and best[j][0] + b - a - over > covered:
                    covered, first = best[j][0] + b - a - over, best[j][1]
            best.append((covered, first))
            if covered >= COVERED * self.sizes[k]:
                tops.append((first, b, min(1.0, covered / self.sizes[k])))
        for first, end, share in sorted(tops, key=lambda t: (-t[2], t[0])):
            at = bisect_left(taken, (first, end))
            if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or taken[at][0] >= end):
                taken.insert(at, (first, end))
                out.append((self.labels[k], False, first, end, share))
        return out


SCHEMA = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES,
         notices: Mapping[str, Sequence[str]] = NOTICES, id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """doc_id, n_words and spans of each row: label, phrase (of the base scan), first word, word behind
    and score (covered share of the template, 1 for a phrase or a short notice).

    A null or empty text has no words and no spans. A template shorter than four words is found by
    nothing; a notice may be of any length. A span inside another of its label is left out. Rows are independent; other columns are not read."""
    scanner = Scanner(templates, phrases, notices)  # bounded by the fixed values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            spans = [[dict(zip(("label", "phrase", "first", "end", "score"), s)) for s in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array(spans, SCHEMA)],
                                             ["doc_id", "n_words", "spans"])

    slim = docs.select(docs[id].alias("doc_id"), docs[text].cast("string").alias("text"))
    span = "struct<label:string,phrase:boolean,first:bigint,end:bigint,score:double>"
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, n_words bigint, spans array<{span}>")
