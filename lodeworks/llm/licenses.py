"""License scans with a generalised suffix automaton of license texts."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodeworks.llm.common import LEXICAL, annotate
from lodeworks.llm.license_bodies import BODIES

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Openings of public license notices, by label.
TEMPLATES = {
    "agpl": "GNU Affero General Public License as published by the Free Software Foundation",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "GNU Lesser General Public License as published by the Free Software Foundation",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
#: Words of a match that takes part in a chain, words two chained matches may lie apart, and the share of a template that
#: a chain must cover to give its label.
LEAST_MATCH, GAP, SHARE = 4, 12, 0.4
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("share", T.DoubleType())]))),
    ]
)


def lexical(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LEXICAL).split()


class Automaton:
    """The suffix automaton of several word sequences: all their substrings, with the places where each ends."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str], bodies: dict[str, tuple[str, ...]] | None = None):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, ends = [-1], [0], [set()]
        self.vocabulary: dict[bytes, int] = {}
        texts = [*templates.items(), *((label, t) for label, body in (bodies or {}).items() for t in body)]
        self.names, self.sizes = [label for label, _ in texts], [len(lexical(t)) for _, t in texts]
        phrase_words = [([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in lexical(p)], label) for p, label in phrases.items()]
        template_words = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in lexical(t)] for _, t in texts]
        for number, words in enumerate([*(w for w, _ in phrase_words), *template_words]):
            last = 0
            for place, word in enumerate(words):
                last = self._extend(last, word, ends)
                if number >= len(phrase_words):
                    ends[last].add((number - len(phrase_words), place + 1))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]
        # Phrases that end where a state's strings end; the last number is the least length for that, 0 if always.
        at: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for words, label in phrase_words:
            state = 0
            for w in words:
                state = self.next[state][w]
            at[state].append((len(words), label))
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.phrases[self.link[state]] if self.link[state] >= 0 else []
            self.phrases[state] = [*above, *at.get(state, [])]

    def _extend(self, last: int, word: int, ends: list[set]) -> int:
        if (to := self.next[last].get(word)) is not None:
            if self.length[to] == self.length[last] + 1:
                return to
            return self._split(last, word, to, ends)
        new = self._state(self.length[last] + 1, ends)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            to = self.next[p][word]
            self.link[new] = to if self.length[to] == self.length[p] + 1 else self._split(p, word, to, ends)
        return new

    def _state(self, length: int, ends: list[set]) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, word: int, to: int, ends: list[set]) -> int:
        copy = self._state(self.length[p] + 1, ends)
        self.next[copy] = dict(self.next[to])
        self.link[copy], self.link[to] = self.link[to], copy
        while p >= 0 and self.next[p].get(word) == to:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def stream(self, ids: list[int], begin: int, found: list, matches: list) -> None:
        """Matching statistics over one run of known words that begins at a document's word begin.

        found gets (start, label) of phrases; matches gets (end, length, state) of matches that nothing extends.
        """
        step, link, length, phrases = self.next, self.link, self.length, self.phrases
        state = n = 0
        for i, word in enumerate(ids):
            if n >= LEAST_MATCH and word not in step[state]:
                matches.append((begin + i, n, state))
            while state and word not in step[state]:
                state = link[state]
                n = length[state]
            to = step[state].get(word)
            if to is None:
                state = n = 0
                continue
            state, n = to, n + 1
            if phrases[state]:
                found += [(begin + i + 1 - size, label) for size, label in phrases[state] if size <= n]
        if n >= LEAST_MATCH:
            matches.append((begin + len(ids), n, state))

    def chains(self, matches: list) -> list[tuple[str, int, int, float]]:
        """For each template all disjoint chains that reach SHARE, the best first: label, span, share.

        Chains are of matches in order, no more than GAP words apart.
        """
        by: dict[int, list] = defaultdict(list)
        for end, n, state in matches:
            for template, place in self.ends[state]:
                by[template].append((end - n, end, place - n, place))
        out = set()
        for template, found in by.items():
            least, start, todo = SHARE * self.sizes[template], 0, []
            for k in range(1, len(found) + 1):  # no chain reaches over more than GAP words
                if k == len(found) or found[k][0] - found[k - 1][1] > GAP:
                    todo.append(found[start:k])
                    start = k
            while todo:
                parts = todo.pop()
                if not parts or parts[-1][1] - min(p[0] for p in parts) < least:
                    continue
                covered, begin, k = self._best(parts)
                if covered < least:
                    continue
                end = parts[k][1]
                out.add((self.names[template], begin, end, min(1.0, covered / self.sizes[template])))
                todo += [[p for p in parts if p[1] <= begin], [p for p in parts if p[0] >= end]]
        return sorted(out)

    def _best(self, parts: list) -> tuple[int, int, int]:
        """The words that the best chain covers, where it begins and its last part; of equal ones that nearest the middle."""
        best: list[tuple[int, int]] = []  # covered words and where the chain begins
        recent: list[int] = []
        for k, (b, e, tb, te) in enumerate(parts):
            score, begin = e - b, b
            recent = [j for j in recent if b - parts[j][1] <= GAP]
            for j in recent:
                _, pe, _, pt = parts[j]
                gain = best[j][0] + (e - b) - max(0, pe - b, pt - tb)
                if pt < te and pe < e and tb - pt <= GAP and gain > score:
                    score, begin = gain, best[j][1]
            best.append((score, begin))
            recent.append(k)
        k = max(range(len(parts)), key=lambda j: (best[j][0], -abs(2 * j - len(parts))))
        return *best[k], k


def scan_text(text: str | None, automaton: Automaton) -> tuple:
    words = lexical(text)
    ids = np.fromiter(map(automaton.vocabulary.get, words, [0] * len(words)), np.int32, len(words))
    known = np.concatenate([[0], (ids > 0).view(np.int8), [0]])
    edges = np.flatnonzero(np.diff(known))
    found: list[tuple[int, str]] = []
    matches: list[tuple[int, int, int]] = []
    for b, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if e - b > 1:  # the shortest phrase has two words
            automaton.stream(ids[b:e].tolist(), b, found, matches)
    spans = automaton.chains(matches) if matches else []
    base = sorted({label for _, label in found})
    share = max((s[3] for s in spans), default=0.0)
    starts = [s for s, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(s[0] for s in spans)})), 1 - (1 - share) * (0.4 if base else 1.0), [dict(zip(("label", "begin", "end", "share"), s, strict=True)) for s in spans])


def scan(docs: DataFrame, text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """docs with the columns of ADDED: license phrases, and spans of license notices with the share they cover.

    Words are lexical, A-Z folded. Each text streams through the suffix automaton of all phrases and templates, which
    gives the longest match that ends at each word: phrases are read off its states, and long matches are chained into
    spans of a template, or of a paragraph of BODIES with the same labels. score is 1 - (1 - largest share) * (0.4 with a phrase, else 1). One pass, no shuffle.

    Null and empty texts have no words, no place and score 0; texts of any length are scanned whole, repeated rows each for
    itself, whatever their ids; spans of equal labels come in order, of one template the best ones first taken. An empty
    table gives no rows; a column of docs named as one of the added gives way.
    """
    bodies = None if templates else BODIES
    phrases, templates = phrases or PHRASES, templates or TEMPLATES

    def make_worker():
        automaton = Automaton(phrases, templates, bodies)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))]

        def worker(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [scan_text(t.as_py(), automaton) for t in batch.column(0)]
            return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

        return worker

    return annotate(docs, [text_col], make_worker, ADDED)
