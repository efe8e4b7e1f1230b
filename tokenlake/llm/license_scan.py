"""Licence scan with a generalised suffix automaton of licence templates.

The automaton holds every run of words of every template. A text is streamed through it: after
each word the state tells the longest run of words, ending there, that some template has (its
matching statistic), and the suffix links behind it the longest such run of every other template.
Each template's own runs that its next word does not make longer and that have at least `least`
words are its matches; per template they are chained, in order in text and
template, and the words of the template that a chain covers make its score. A template counts as
found when a chain covers `share` of it or one match has `long` words.

Words that no template knows cut every match, so only stretches of known words are streamed; all
words of the text are looked up in one vectorised step.

The base labels come from four fixed phrases and are always among the labels.

Defined results: a null or empty text has no words, empty labels and score 0; repeated rows and null
ids pass through; extra columns are not looked at; of matches that cover as much the first counts; an
empty table gives an empty one; a text of any length is streamed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.arrays import Words, texts
from tokenlake.llm.store import text_batches

#: Phrases of the base count and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Wordings of licences and notices, by the label they stand for.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"

NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x41:0x5B] = NOT_WORD[0x61:0x7B] = False
NOT_WORD[0x80:] = False


@dataclass(frozen=True)
class Plan:
    """least: words of a match; share: covered part of a template that finds it; long: words of a match that finds it alone."""

    least: int = 4
    share: float = 0.8
    long: int = 12


def words_of(text: str) -> Words:
    raw = np.frombuffer(text.encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), lower=True, is_space=NOT_WORD)


class Automaton:
    """Generalised suffix automaton of word-number sequences; each state knows where its runs first end in each template."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for t, sequence in enumerate(sequences):
            last = 0
            for i, c in enumerate(sequence):
                last = self._extend(last, c)
                self.ends[last].setdefault(t, i)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            for t, i in self.ends[s].items():
                up = self.ends[self.link[s]]
                up[t] = min(i, up.get(t, i))

    def _new(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def statistics(self, stream: Iterable[int]) -> Iterator[tuple[int, int]]:
        """(longest run that ends here, its state) for each word."""
        state, n = 0, 0
        for c in stream:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            yield n, state

    def runs(self, n: int, state: int, least: int) -> dict[int, tuple[int, int]]:
        """By template: (words, first end in the template) of its longest run that ends where the longest of all, n words in this state, does."""
        out: dict[int, tuple[int, int]] = {}
        while state and n >= least:
            for t, end in self.ends[state].items():
                if t not in out:
                    out[t] = (n, end)
            state = self.link[state]
            n = self.length[state]
        return out


class Scanner:
    """Templates, their automaton and the word table."""

    def __init__(self, templates: list[tuple[str, str]], plan: Plan = Plan()):
        self.plan, self.labels = plan, [x for x, _ in templates]
        hashes = [words_of(t).hash for _, t in templates]
        self.vocabulary = np.unique(np.concatenate(hashes))
        sequences = [np.searchsorted(self.vocabulary, h).tolist() for h in hashes]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        self.phrases = [(label, words_of(p).hash) for p, label in BASE_PHRASES.items()]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each word, -1 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def matches(self, numbers: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """By template: (start in the text, start in the template, words) of its matches that it cannot make longer."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        known = np.concatenate([[False], numbers >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        for a, b in edges.reshape(-1, 2):
            if b - a < self.plan.least:
                continue
            stream = itertools.chain.from_iterable(numbers[k : min(k + 4096, b)].tolist() for k in range(int(a), int(b), 4096))
            now: dict[int, tuple[int, int]] = {}
            for k, (m, state) in enumerate(itertools.chain(self.automaton.statistics(stream), [(0, 0)])):
                after = self.automaton.runs(m, state, self.plan.least)
                for t, (n, end) in now.items():
                    if t not in after or after[t][0] <= n:
                        found.setdefault(t, []).append((int(a) + k - n, end - n + 1, n))
                now = after
        return found

    def chain(self, found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
        """(template words covered, first word, end) of the best chain in order in both texts.

        A gap in the text wider than the matches before it ends a chain, so far copies are chained apart.
        """
        best: list[tuple[int, int]] = []
        top = (0, 0, 0)
        found = sorted(found)
        reach = 50 + max(n for _, _, n in found)  # no match that begins further back can be near enough
        for i, (x, y, n) in enumerate(found):
            cover, begin = n, x
            for j in range(i - 1, -1, -1):
                x2, y2, n2 = found[j]
                if x - x2 > reach:
                    break
                if x2 + n2 <= x and y2 + n2 <= y and x - x2 - n2 <= 50 and best[j][0] + n > cover:
                    cover, begin = best[j][0] + n, best[j][1]
            best.append((cover, begin))
            top = max(top, (cover, begin, x + n))
        return top

    def scan(self, hashes: np.ndarray, numbers: np.ndarray) -> tuple[int, int | None, int | None, str, str, float, str]:
        """The figures of one text."""
        base, places = set(), []
        for label, phrase in self.phrases:
            hit = np.flatnonzero(hashes[: len(hashes) - len(phrase) + 1] == phrase[0]) if len(hashes) >= len(phrase) else hashes[:0]
            for k in range(1, len(phrase)):
                hit = hit[hashes[hit + k] == phrase[k]]
            if len(hit):
                base.add(label)
                places.append(hit)
        labels, score, spans = set(base), 0.0, []
        for t, found in self.matches(numbers).items():
            cover, begin, end = self.chain(found)
            share = cover / self.sizes[t]
            score = max(score, share)
            if share >= self.plan.share or max(n for _, _, n in found) >= self.plan.long:
                labels.add(self.labels[t])
                spans.append(f"{self.labels[t]}:{begin}-{end}")
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        join = lambda x: ",".join(sorted(x))
        return len(at), (int(at.min()) if len(at) else None), (int(at.max()) if len(at) else None), join(base), join(labels), min(1.0, score), join(set(spans))


@lru_cache(maxsize=2)
def scanner(plan: Plan, templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES)) -> Scanner:
    return Scanner(list(templates), plan)


def scan_licenses(docs: DataFrame, plan: Plan = Plan(), templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """SCHEMA for each row of docs(doc_id, text); spans: label:first-end in words of what chains cover.

    templates: (label, wording) of what to look for; wordings of any length, whole licences too. Their automaton goes to every task.
    """
    text_batches(docs.sparkSession)
    wanted = tuple((label, wording) for label, wording in templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(plan, wanted)
        starts = np.array([p[0] for _, p in s.phrases])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in texts(batch, "text"):
                w = Words(data, offsets, lower=True, is_space=NOT_WORD)
                numbers = s.numbers(w.hash)
                # only texts with a base phrase's first word or enough known words in a row can show anything
                known = np.concatenate([[0], np.cumsum(numbers < 0)])
                k = s.plan.least
                runs = np.flatnonzero(known[k:] == known[:-k]) if len(numbers) >= k else np.zeros(0, np.int64)
                some = np.zeros(hi - lo, bool)
                some[w.doc[runs]] = True
                some[w.doc[np.isin(w.hash, starts)]] = True
                rows = []
                for i in range(hi - lo):
                    a, b = w.first[i], w.first[i + 1]
                    rows.append((b - a, *(s.scan(w.hash[a:b], numbers[a:b]) if some[i] else (0, None, None, "", "", 0.0, ""))))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
