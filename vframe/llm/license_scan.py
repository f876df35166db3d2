"""Licence scan by a generalised suffix automaton.

The automaton accepts every run of words of every template. Streaming a text through
it gives the matching statistics: at each word, the length of the longest run ending
there that some template holds. Its state, and the states on its suffix links, hold all the places in templates
where that run or an ending of it stands. Places that move on with the text are matches; they are chained, in text order and in template order, by
dynamic programming for the largest cover, a later match losing what overlaps the one before.
Chains that cover enough of their template are spans. Memory is the automaton, whose size the templates fix.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vframe.llm.common import ascii_lower

# Phrases that count wherever they stand, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public licence notices, and whole licences where they are short. Signs and case don't count.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl": [
        "This work is licensed under the GNU General Public License version 3",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 3 of the License, or (at your "
        "option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "reserved": ["All rights reserved"],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.",
    ],
    "zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions",
    ],
}

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of a match that counts, or its whole template if that is shorter.
LEAST_MATCH = 3
#: Words of the text that a chain may skip between two matches.
GAP = 6
#: Share of a template's words that a span has to cover.
LEAST_COVER = 0.75


@dataclass
class State:
    length: int = 0
    link: int = -1
    ends: list[int] = field(default_factory=list)  # where its runs end in the joined templates
    next: dict[int, int] = field(default_factory=dict)


class Match(NamedTuple):
    start: int  # in the text
    at: int  # in the joined templates
    length: int


class Automaton:
    """A generalised suffix automaton over word numbers; states of runs of ``least`` words or more know all their ends."""

    def __init__(self, texts: list[list[int]], least: int = 1) -> None:
        self.states, self.least = [State()], least
        at = 0
        for text in texts:
            last = 0
            for word in text:
                last = self._extend(last, word)
                self.states[last].ends.append(at)
                at += 1
            at += 1  # a gap, so that no match goes on from one template to the next
        for state in sorted(self.states, key=lambda s: -s.length):
            if state.link >= 0 and self.states[state.link].length >= least:
                self.states[state.link].ends += state.ends

    def _extend(self, last: int, word: int) -> int:
        states = self.states
        if word in states[last].next:
            known = states[last].next[word]
            if states[known].length == states[last].length + 1:
                return known
            return self._split(last, word, known)
        states.append(State(states[last].length + 1, 0))
        fresh, p = len(states) - 1, last
        while p >= 0 and word not in states[p].next:
            states[p].next[word] = fresh
            p = states[p].link
        if p >= 0:
            known = states[p].next[word]
            longer = states[known].length != states[p].length + 1
            states[fresh].link = self._split(p, word, known) if longer else known
        return fresh

    def _split(self, p: int, word: int, known: int) -> int:
        states = self.states
        old = states[known]
        states.append(State(states[p].length + 1, old.link, [], dict(old.next)))
        clone = len(states) - 1
        old.link = clone
        while p >= 0 and states[p].next.get(word) == known:
            states[p].next[word] = clone
            p = states[p].link
        return clone

    def statistics(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """At each word the state and the length of the longest run of a template that ends there."""
        states, state, length = self.states, 0, 0
        for word in words:
            while state and word not in states[state].next:
                state = states[state].link
                length = states[state].length
            if word in states[state].next:
                state, length = states[state].next[word], length + 1
            yield state, length

    def matches(self, words: list[int]) -> list[Match]:
        """All runs of ``least`` words or more that the text shares with a place in the templates and that neither side lengthens."""
        states, out = self.states, []
        running: dict[int, Match] = {}  # by the place in the templates where it goes on
        for i, (state, length) in enumerate(self.statistics(words)):
            now: dict[int, Match] = {}
            while length >= self.least:
                for end in states[state].ends:
                    if end + 1 not in now:
                        before = running.pop(end, None)
                        now[end + 1] = Match(before.start, before.at, before.length + 1) if before else Match(i - length + 1, end - length + 1, length)
                state = states[state].link
                length = states[state].length
            out += running.values()
            running = now
        return [*out, *running.values()]


def chains(matches: list[Match], gap: int) -> list[tuple[int, int, int]]:
    """The best chains of one template's matches as (start, end, words covered), each text place in one chain.

    Matches follow each other in text and template, at most ``gap`` words of the text apart; a later one loses what overlaps the one
    before. Of all chains that end in a match the one of most words counts.
    """
    matches = sorted(matches)
    longest = max((m.length for m in matches), default=0)
    best: list[tuple[int, int]] = []  # words covered, and the start of the chain
    first = 0
    for j, m in enumerate(matches):
        while matches[first].start < m.start - gap - longest:
            first += 1
        covered, start = m.length, m.start
        for i in range(first, j):
            b = matches[i]
            lost = max(0, b.start + b.length - m.start, b.at + b.length - m.at)
            if lost < m.length and m.start + lost - b.start - b.length <= gap and best[i][0] + m.length - lost > covered:
                covered, start = best[i][0] + m.length - lost, best[i][1]
        best.append((covered, start))
    out: list[tuple[int, int, int]] = []
    taken: list[tuple[int, int]] = []
    for (covered, start), m in sorted(zip(best, matches, strict=True), key=lambda x: (-x[0][0], x[0][1])):
        end = m.start + m.length
        k = bisect.bisect(taken, (start, end))
        if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= end):
            taken.insert(k, (start, end))
            out.append((start, end, covered))
    return out


class Scanner:
    """Templates, their automaton and the scan of one text."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> None:
        self.number: dict[str, int] = {}
        code = lambda text: [self.number.setdefault(w, len(self.number)) for w in WORD.findall(text.lower())]
        self.phrases = [(np.array(code(p)), label) for p, label in phrases.items()]
        self.labels, self.texts = [], []
        for label, texts in templates.items():
            for text in texts:
                self.labels.append(label)
                self.texts.append(code(text))
        self.least = min(LEAST_MATCH, *map(len, self.texts))
        self.automaton = Automaton(self.texts, self.least)
        self.owner = np.repeat(np.arange(len(self.texts)), [len(t) + 1 for t in self.texts])  # the template of each joined word

    def _places(self, codes: np.ndarray) -> Iterator[tuple[int, str]]:
        """Where the phrases stand."""
        for phrase, label in self.phrases:
            n = len(codes) - len(phrase) + 1
            if n > 0:
                here = np.ones(n, bool)
                for k, word in enumerate(phrase):
                    here &= codes[k : k + n] == word
                for at in np.flatnonzero(here):
                    yield int(at), label

    def _spans(self, codes: np.ndarray) -> list[tuple[int, int, str, float]]:
        """Covered template spans: (start, end, label, cover), from the stretches whose words templates have."""
        known = codes >= 0
        edges = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
        by_template: dict[int, list[Match]] = {}
        for start, end in edges.reshape(-1, 2):
            if end - start >= self.least:
                for m in self.automaton.matches(codes[start:end].tolist()):
                    by_template.setdefault(int(self.owner[m.at]), []).append(Match(int(start) + m.start, m.at, m.length))
        out = []
        for t, mine in by_template.items():
            size = len(self.texts[t])
            for start, end, covered in chains(mine, GAP):
                if covered >= LEAST_COVER * size:
                    out.append((start, end, self.labels[t], min(1.0, covered / size)))
        return out

    def scan(self, words: list[str]) -> dict:
        """What a text holds, by its words."""
        codes = np.fromiter(map(self.number.get, words, [-1] * len(words)), np.int64, len(words))
        places = sorted(self._places(codes))
        spans = self._spans(codes)
        base = {label for _, label in places}
        score = max([cover for *_, cover in spans] + [1.0] * bool(places), default=0.0)
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": places[0][0] if places else None,
            "last_word": places[-1][0] if places else None,
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {label for *_, label, _ in spans})),
            "score": score,
            "spans": [{"start": int(a), "end": int(b), "label": label, "cover": c} for a, b, label, c in sorted(spans)],
        }


FOUND = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<start:long,end:long,label:string,cover:double>>"
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find licence phrases and covered template spans in every whole text.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans
    (in words, end exclusive), one row for each input row. A score is the largest cover of a span, or
    1 where a phrase stands. Null and empty texts have no words, no
    places, empty labels and score 0. Repeated rows give repeated results; no rows
    give none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("cover", pa.float64())])
        kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64()}
        kinds |= {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(span)}
        for batch in batches:
            texts = batch.column(1)
            found = [scanner.scan(WORD.findall(texts[i].as_py())) for i in range(len(texts))]
            columns = [pa.array([f[k] for f in found], t) for k, t in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *kinds])

    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text")
    )
    return source.mapInArrow(run, FOUND)
