"""License scans by a generalised suffix automaton of licence tokens.

One automaton holds the token strings of all templates and phrases. A text is streamed through it, which gives
for every word the longest match with any template that ends there (matching statistics); words that cannot
be in a match of two words are stepped over, since the automaton would be back at its root there. Places of
the base phrases are the states that have the phrase as a suffix. Matches of at least MIN_MATCH words are
chained per template, in order and with gaps of at most MAX_GAP words (none in notices of up to SHORT words), into
spans; a template whose words are covered to MIN_COVER gives its label, under two conditions. The words that tell
licences apart (numbers, and VARIANTS) must be the same in the span as in the template, in order; and of spans with
different labels that share half of the shorter one, that which covers most words stands. Each place of a
notice gives a span. The score is 1 with a base phrase, else the best coverage of a span with a label, else the
best coverage of any chain, but at most MIN_COVER.

Defined cases: a null or empty text has no words, no places and score 0; repeated rows each get a row; null
ids stay; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map

MIN_MATCH, MAX_GAP, MIN_COVER, SHORT = 4, 12, 0.6, 20

# The phrases of the contract, and notices of public licences.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "This work is licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)

# Words that tell variants of a licence apart, beside numbers.
VARIANTS = frozenset(b"noncommercial sharealike noderivatives noderivs nc sa nd lesser affero library clear".split())

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case; runs of a-z, 0-9 and everything beyond ASCII."""
    return (text or "").encode().translate(_TO_WORDS).split()


def tells(word: bytes) -> bool:
    return word.isdigit() or word in VARIANTS


class Automaton:
    """Generalised suffix automaton over numbered words, with the places of its states in the strings."""

    def __init__(self, strings: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for which, string in enumerate(strings):
            last = 0
            for at, word in enumerate(string):
                last = self._extend(last, word, ends)
                ends[last].add((which, at))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for v in order:  # a state's strings also end where those of the longer states below it do
            ends[self.link[v]] |= ends[v]
        self.ends = [tuple(sorted(e)) for e in ends]

    def _new(self, length: int, edges: dict[int, int], link: int, ends: list) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: int, ends: list) -> int:
        """The state of p's longest string and word, out of q, which also holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int, ends: list) -> int:
        if (q := self.next[last].get(word)) is not None:
            return self._split(last, q, word, ends)
        new = self._new(self.length[last] + 1, {}, 0, ends)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][word], word, ends)
        return new

    def state(self, string: list[int]) -> int:
        v = 0
        for word in string:
            v = self.next[v][word]
        return v

    def stream(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        v = n = 0
        for word in words:
            while v and word not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if (to := self.next[v].get(word)) is None:
                v = n = 0
            else:
                v, n = to, n + 1
            yield v, n


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, min_match: int = MIN_MATCH, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.number: dict[bytes, int] = {}
        strings = [[self.number.setdefault(w, len(self.number) + 1) for w in words_of(t)] for t in (*phrases, *(t for _, t in templates))]
        if any(len(s) < 2 for s in strings):
            raise ValueError("phrases and templates have at least two words")
        self.automaton = a = Automaton(strings)
        self.first_template = len(phrases)
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        self.sizes = [len(s) for s in strings]
        self.telling = [[w for w in words_of(t) if tells(w)] for t in (*phrases, *(t for _, t in templates))]
        own = {a.state(s): i for i, s in enumerate(strings[: len(phrases)])}
        #: Of each state: the phrases that its strings end with.
        self.phrases: list[tuple[int, ...]] = []
        for v in range(len(a.link)):
            found, u = [], v
            while u > 0:
                if u in own:
                    found.append(own[u])
                u = a.link[u]
            self.phrases.append(tuple(found))
        size = len(self.number) + 1
        self.pairs = np.zeros(size * size, bool)
        for s in strings:
            for x, y in zip(s, s[1:], strict=False):
                self.pairs[x * size + y] = True

    def scan(self, text: str | None) -> dict:
        """n_words, places [(word, phrase)], spans [(template, first word, end, coverage)], and the best coverage of any chain."""
        words = words_of(text)
        ids = np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []  # first word, length, state
        if len(ids) > 1:
            linked = self.pairs[ids[:-1] * (len(self.number) + 1) + ids[1:]]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], linked.view(np.int8), [0]))))
            for a, b in edges.reshape(-1, 2).tolist():  # words a to b, the last included, may match together
                before = (0, 0)
                for at, (v, n) in enumerate(self.automaton.stream(ids[a : b + 1].tolist()), a):
                    for p in self.phrases[v]:
                        if n >= self.sizes[p]:
                            places.append((at - self.sizes[p] + 1, p))
                    if n <= before[1] and before[1] >= self.min_match:
                        matches.append((at - before[1], before[1], before[0]))
                    before = v, n
                if before[1] >= self.min_match:
                    matches.append((b + 1 - before[1], before[1], before[0]))
        spans, best = self._spans(matches, words)
        return {"n_words": len(words), "places": places, "spans": spans, "best": best}

    def _chains(self, which: int, own: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Words covered, first word, end of chains of a template's matches: each goes on from the best one that ends within the gap before it."""
        gap = self.max_gap if self.sizes[which] > SHORT else 0
        chains: list[tuple[int, int, int, int]] = []  # the last is the end in the template
        start = 0
        for first, n, at in own:
            while start < len(chains) and chains[start][2] + gap < first:
                start += 1
            now = (n, first, first + n, at + n)
            for covered, began, end, place in chains[start:]:
                skip = max(0, end - first, place - at)  # words that the chain has already
                if skip < n and at + skip - place <= gap and 0 <= first + skip - end <= gap:
                    now = max(now, (covered + n - skip, began, first + n, at + n), key=lambda c: c[0])
            chains.append(now)
        kept: list[tuple[int, int, int]] = []
        for covered, began, end, _ in sorted(chains, key=lambda c: (-c[0], c[1])):
            if all(end <= a or b <= began for _, a, b in kept):
                kept.append((covered, began, end))
        return kept

    def _spans(self, matches: list[tuple[int, int, int]], words: list[bytes]) -> tuple[list[tuple[int, int, int, float]], float]:
        parts: dict[int, list[tuple[int, int, int]]] = {}
        for first, n, state in matches:
            for which, end in self.automaton.ends[state]:
                if which >= self.first_template:
                    parts.setdefault(which, []).append((first, n, end - n + 1))
        best, found = 0.0, []  # covered words, template, first word, end
        for which, own in parts.items():
            for covered, began, end in self._chains(which, own):
                share = covered / self.sizes[which]
                best = max(best, share)
                if share >= self.min_cover and [w for w in words[began:end] if tells(w)] == self.telling[which]:
                    found.append((covered, which, began, end))
        kept: list[tuple[int, int, int, int]] = []
        for span in sorted(found, key=lambda x: (-x[0] / self.sizes[x[1]], -x[0], x[1], x[2])):
            _, which, began, end = span
            shared = lambda k: 2 * (min(end, k[3]) - max(began, k[2])) >= min(end - began, k[3] - k[2])  # noqa: B023, E731
            if not any(self.labels[k[1]] != self.labels[which] and shared(k) for k in kept if k[0] >= span[0]):
                kept = [k for k in kept if self.labels[k[1]] == self.labels[which] or not shared(k)]
                kept.append(span)
        spans = [(which, began, end, covered / self.sizes[which]) for covered, which, began, end in kept]
        return sorted(spans, key=lambda s: (-s[3], s[1], s[0])), best

    def row(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
        found = self.scan(text)
        starts = [a for a, _ in found["places"]]
        base = {self.labels[p] for _, p in found["places"]}
        labels = base | {self.labels[s[0]] for s in found["spans"]}
        score = 1.0 if base else max((min(1.0, s[3]) for s in found["spans"]), default=min(found["best"], self.min_cover))
        spans = [{"label": self.labels[w], "first_word": a, "end": b, "coverage": c} for w, a, b, c in found["spans"]]
        return found["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end:long,coverage:double>>"
_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **asked) -> DataFrame:
    """A row for each row of docs; spans are the covered templates, ends excluded. asked: what Scanner takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(**asked)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(_SPAN)]
        for b in batches:
            rows = [scanner.row(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, _SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
