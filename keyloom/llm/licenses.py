"""License scans with a generalised suffix automaton over the words of licence templates.

The automaton accepts every run of words of every template. A document streams through it; the length of the longest
match that ends at each word are its matching statistics. Maximal matches of MIN_MATCH words or more become anchors at
their places in the templates, and anchors of one template that go forward in both texts with small gaps are chained to
covered spans. Word pairs that stand in no template can't be inside a match of two words, so only stretches of known
pairs are streamed.

Defined cases: null, empty and wordless texts have no words, no labels and score 0; a very long text takes time in
proportion to its words; equal rows are scored alike; an empty table gives none; only doc_id and text are read, so other
columns may have any names. Ties between spans go to the earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from keyloom.llm.common import blocks, map_batches, read_table, text_rows, words_of
from keyloom.llm.license_texts import FULL_TEXTS

#: (label, phrase): their places are always found.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

#: (label, text): notices of public licences.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "This project is licensed under the terms of the MIT license"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
    *FULL_TEXTS,
)

MIN_MATCH = 3
MAX_GAP = 8
#: Share of a template that a span must cover, or the words that suffice.
MIN_COVER, ENOUGH_WORDS = 0.6, 24


@dataclass
class Automaton:
    """A generalised suffix automaton over word numbers, from 1."""

    words: dict[bytes, int] = field(default_factory=dict)
    go: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])  # (template, end)
    phrases: dict[int, list[int]] = field(default_factory=dict)  # by state: the phrases that end there, link chain included
    sizes: list[int] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    phrase_sizes: list[int] = field(default_factory=list)
    phrase_labels: list[str] = field(default_factory=list)

    def _state(self, length: int, go: dict[int, int], link: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.go) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.go[q]), self.link[q])
        while p >= 0 and self.go[p].get(c) == q:
            self.go[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.go[last].get(c)
        if q is not None:  # another template has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.go[p]:
            self.go[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, tokens: list[int]) -> None:
        last = 0
        for c in tokens:
            last = self._extend(last, c)

    @staticmethod
    def of(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Automaton:
        a = Automaton()
        number = lambda text: [a.words.setdefault(w, len(a.words) + 1) for w in words_of(text.encode())]
        runs, named = [number(t) for _, t in templates], [number(t) for _, t in phrases]
        for run in runs + named:
            a.add(run)
        a.sizes, a.labels = [len(r) for r in runs], [x for x, _ in templates]
        a.phrase_sizes, a.phrase_labels = [len(r) for r in named], [x for x, _ in phrases]
        for t, run in enumerate(runs):
            s = 0
            for k, c in enumerate(run):
                s = a.go[s][c]
                a.ends[s].add((t, k + 1))
        for s in sorted(range(len(a.go)), key=a.length.__getitem__, reverse=True):
            if a.link[s] > 0:
                a.ends[a.link[s]] |= a.ends[s]
        at: dict[int, list[int]] = {}
        for k, run in enumerate(named):
            s = 0
            for c in run:
                s = a.go[s][c]
            at.setdefault(s, []).append(k)
        for s in range(len(a.go)):
            found, p = [], s
            while p > 0:
                found += at.get(p, [])
                p = a.link[p]
            if found:
                a.phrases[s] = found
        a.pairs = np.zeros((len(a.words) + 1) ** 2, bool)
        for run in runs + named:
            for x, y in zip(run, run[1:], strict=False):
                a.pairs[x * (len(a.words) + 1) + y] = True
        return a

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match that ends here) for each word."""
        s = n = 0
        for c in tokens:
            while s and c not in self.go[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.go[s]:
                s = self.go[s][c]
                n += 1
            yield s, n

    def scan(self, stretches: list[tuple[int, list[int]]]) -> dict:
        """What the stretches (first word, word numbers) of one document hold: places of phrases and covered spans."""
        places: list[tuple[int, int]] = []
        anchors: list[tuple[int, int, int, int]] = []  # template, start, start in the template, words
        for first, tokens in stretches:
            s = n = 0
            for k, (state, size) in enumerate(self.statistics(tokens)):
                if n >= MIN_MATCH and size != n + 1:
                    anchors += [(t, first + k - n, e - n, n) for t, e in self.ends[s]]
                s, n = state, size
                for p in self.phrases.get(s, ()):
                    if n >= self.phrase_sizes[p]:
                        places.append((p, first + k + 1 - self.phrase_sizes[p]))
            if n >= MIN_MATCH:
                anchors += [(t, first + len(tokens) - n, e - n, n) for t, e in self.ends[s]]
        return {"places": places, "spans": self.chain(anchors)}

    def chain(self, anchors: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, start, end, share covered) of chains that cover enough. Anchors come by start, so a chain that is over
        MAX_GAP words behind is never looked at again."""
        spans = []
        open_: dict[int, list[list[int]]] = {}

        def close(t: int, chains: list[list[int]]) -> None:
            for c in chains:
                if c[3] >= min(ENOUGH_WORDS, MIN_COVER * self.sizes[t]):
                    spans.append((t, c[0], c[1], min(1.0, c[3] / self.sizes[t])))

        for t, start, there, n in sorted(anchors, key=lambda a: (a[1], -a[3], a[0], a[2])):
            chains = open_.get(t, [])
            if any(start - c[1] > MAX_GAP for c in chains):
                close(t, [c for c in chains if start - c[1] > MAX_GAP])
                chains = [c for c in chains if start - c[1] <= MAX_GAP]
            open_[t] = chains
            best = None
            for c in chains:  # c: start, end, end in the template, words covered
                if start >= c[1] and there >= c[2] and there - c[2] <= 2 * MAX_GAP:
                    best = c if best is None or c[3] > best[3] else best
            if best is None:
                chains.append([start, start + n, there + n, n])
            else:
                best[1:] = [start + n, there + n, best[3] + n]
        for t, chains in open_.items():
            close(t, chains)
        return sorted(spans, key=lambda x: (x[1], x[2], x[0]))


def scan_documents(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """One row per document: counts, labels, score and the spans (label, first word, end word, share covered)."""
    size = len(automaton.words) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = automaton.words.get
        for keys, texts in blocks(batches):
            rows = []
            words = [words_of(t) for t in texts]
            ids = np.fromiter((get(w, 0) for ws in words for w in (*ws, b"")), np.int64, sum(map(len, words)) + len(words))
            bounds = np.cumsum([0] + [len(w) + 1 for w in words])
            known = automaton.pairs[ids[:-1] * size + ids[1:]]  # a pair that starts here
            edge = np.diff(np.concatenate([[0], known.view(np.int8), [0]]))
            begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
            owner = np.searchsorted(bounds, begins, "right") - 1
            stretches: list[list] = [[] for _ in texts]
            for d, a, b in zip(owner.tolist(), begins.tolist(), ends.tolist(), strict=True):
                stretches[d].append((a - int(bounds[d]), ids[a:b].tolist()))
            for key, ws, own in zip(keys, words, stretches, strict=True):
                found = automaton.scan(own) if own else {"places": [], "spans": []}
                at = [p for _, p in found["places"]]
                base = {automaton.phrase_labels[p] for p, _ in found["places"]}
                spans = [(automaton.labels[t], a, b, c) for t, a, b, c in found["spans"]]
                cover = max((c for *_, c in spans), default=0.0)
                rows.append(
                    {
                        "doc_id": key,
                        "n_words": len(ws),
                        "n_base": len(at),
                        "first_word": min(at, default=None),
                        "last_word": max(at, default=None),
                        "base_labels": ",".join(sorted(base)),
                        "labels": ",".join(sorted(base | {x for x, *_ in spans})),
                        "score": max(cover, 0.5 if at else 0.0),
                        "spans": [dict(zip(("label", "start", "end", "cover"), s, strict=True)) for s in spans],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)

    return map_batches(text_rows(docs), run, SCHEMA)


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, start: long, end: long, cover: double>>"
)
ARROW_SCHEMA = pa.schema(
    [
        *[(n, pa.int64()) for n in ("doc_id", "n_words", "n_base", "first_word", "last_word")],
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))),
    ]
)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read_table(spark, sf_dir, "documents"), Automaton.of(TEMPLATES, PHRASES))
