"""Licence scan by a generalised suffix automaton over the tokens of licence templates.

The automaton of all templates is built once on the driver (its size is fixed by the
templates, not by the corpus). Every document's tokens stream through it; at each token it
gives the matching statistic: the longest run ending there that occurs in any template.
Base phrases are templates too, so their occurrences are the suffix links of the state.
Long maximal matches are then chained, in order, into covered spans of a template.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import WORD, documents, lower

# Phrase and label of the base scan.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Public licence notices, label and opening or notice text.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl", "is licensed under the GNU Lesser General Public License"),
    ("agpl-3", "under the terms of the GNU Affero General Public License version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]


def words_of(text: str) -> list[str]:
    return WORD.findall(lower(text))


@dataclass
class Automaton:
    """Generalised suffix automaton over integer tokens.

    `up[s]` are the base phrases whose whole token string is a suffix of the longest string of state
    s. `own` has an automaton of each template alone, whose `where[s]` are all end positions of s's strings."""

    vocab: dict[str, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    where: list[list[int]] = field(default_factory=lambda: [[]])
    own: list[Automaton] = field(default_factory=list)
    up: list[list[tuple[int, int]]] = field(default_factory=list)

    def _state(self, length: int, moves: dict[int, int] | None = None, link: int = 0) -> int:
        self.next.append(dict(moves or {}))
        self.link.append(link)
        self.length.append(length)
        self.where.append([])
        return len(self.next) - 1

    def _split(self, p: int, token: int) -> int:
        """The state for p + token with length one more than p's, cloned off if need be."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.next[q], self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[str]) -> None:
        last = 0
        for word in words:
            token = self.vocab.setdefault(word, len(self.vocab))
            if token in self.next[last]:
                last = self._split(last, token)
                continue
            new, p = self._state(self.length[last] + 1), last
            while p >= 0 and token not in self.next[p]:
                self.next[p][token] = new
                p = self.link[p]
            self.link[new] = self._split(p, token) if p >= 0 else 0
            last = new

    def place(self, words: list[str]) -> None:
        """Give every state all places at which its strings end in the one template."""
        s = 0
        for end, word in enumerate(words):
            s = self.next[s][self.vocab[word]]
            self.where[s].append(end)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.where[self.link[s]] += self.where[s]

    def runs(self, words: list[str], least: int) -> Iterator[tuple[int, int, int]]:
        """(end word, words, state) of each match that can't be longer."""
        state = run = 0
        for i, token in enumerate([*map(self.vocab.get, words), None]):
            if token in self.next[state]:
                state, run = self.next[state][token], run + 1
                continue
            if run >= least:
                yield i - 1, run, state
            while state > 0 and token not in self.next[state]:
                state = self.link[state]
            run = self.length[state]
            if token in self.next[state]:
                state, run = self.next[state][token], run + 1

    def mark(self, phrases: list[list[str]]) -> None:
        """Give every state the phrases (number, length) that are suffixes of its strings."""
        own: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(phrases):
            s = 0
            for w in words:
                s = self.next[s][self.vocab[w]]
            own.setdefault(s, []).append((k, len(words)))
        self.up = [[] for _ in self.next]
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.up[s] = own.get(s, []) + (self.up[self.link[s]] if self.link[s] >= 0 else [])


def build(templates=None, base=None) -> tuple[Automaton, list[tuple[str, int]], list[tuple[str, int]]]:
    """The automaton with (label, words) of each template and of each base phrase."""
    templates, base = TEMPLATES if templates is None else templates, BASE if base is None else base
    phrases = [words_of(p) for p in base]
    rows = sorted(((label, words_of(t)) for label, t in templates), key=lambda r: len(r[1]))
    out = Automaton()
    for words in [w for _, w in rows] + phrases:
        out.add(words)
    for _, words in rows:
        out.own.append(Automaton())
        out.own[-1].add(words)
        out.own[-1].place(words)
    out.mark(phrases)
    return out, [(label, len(w)) for label, w in rows], list(zip(base.values(), map(len, phrases)))


def scan(model, text: str, least: int = 4, cover: float = 0.6) -> dict:
    """Matching statistics of one text, base places, and chained template spans.

    least: words of a match that may join a chain; cover: share of a template's words that a
    chain must cover to give its label. A chain takes matches of one template in the order of
    the text and of the template; a gap over the template's length starts another chain."""
    auto, templates, phrases = model
    words = words_of(text)
    nxt, link, length, up = auto.next, auto.link, auto.length, auto.up
    state = run = 0
    base: list[tuple[int, int]] = []
    runs: list[tuple[int, int, int]] = []  # end word, words, state: matches that can't be longer
    for i, token in enumerate(map(auto.vocab.get, words)):
        if token is None:
            if run >= least:
                runs.append((i - 1, run, state))
            state = run = 0
            continue
        if token in nxt[state]:
            state, run = nxt[state][token], run + 1
        else:
            if run >= least:
                runs.append((i - 1, run, state))
            while state > 0 and token not in nxt[state]:
                state = link[state]
            run = length[state]
            if token in nxt[state]:
                state, run = nxt[state][token], run + 1
        if up[state]:
            base += [(i + 1 - n, k) for k, n in up[state] if n <= run]
    if run >= least:
        runs.append((len(words) - 1, run, state))
    spans, best = _chain(_template_runs(auto, words, runs, least), templates, cover, lambda t, a, b: sum(w in auto.own[t].vocab for w in words[a : b + 1]))
    labels = {phrases[k][0] for _, k in base}
    return {
        "n_words": len(words),
        "base": base,
        "base_labels": sorted(labels),
        "labels": sorted(labels | {templates[t][0] for t, *_ in spans}),
        "spans": spans,
        "score": 1.0 if base else best,
    }


def _template_runs(auto, words, runs, least):
    """By template: (end word, words, place) of every match in it that can't be longer. All lie in the runs of the whole automaton."""
    parts: list[list[int]] = []
    for end, n, _ in runs:
        if parts and end - n < parts[-1][1]:
            parts[-1][1] = end + 1
        else:
            parts.append([end - n + 1, end + 1])
    return {t: [(a + end, n, at) for a, b in parts for end, n, state in own.runs(words[a:b], least) for at in own.where[state]] for t, own in enumerate(auto.own)} if parts else {}


def _chain(runs, templates, cover, known):
    """(template, first word, last word, covered words) of each chain with enough cover; the best cover.

    Of a template's chains that end with a run at a place, the one that covers most is kept; of chains
    that share words of the text, the one that covers most (then: whose words the template knows, then the
    larger share; equal ones all). Where runs overlap, the later one counts from there on."""
    ends: dict[int, list[tuple[int, int, int, int]]] = {}  # by template: last word, place in it, first word, covered
    for t, own in runs.items():
        chains = ends[t] = []
        for end, n, at in own:
            first, covered = end - n + 1, n
            for last, done, begin, so_far in reversed(chains):
                if end - n + 1 - last > templates[t][1]:
                    break
                new = min(n, end - last, at - done)
                if new > 0 and so_far + new > covered:
                    first, covered = begin, so_far + new
            chains.append((end, at, first, covered))
    found, best = [], 0.0
    for t, chains in ends.items():
        for last, _, first, covered in chains:
            share = min(1.0, covered / templates[t][1])
            best = max(best, share)
            if share >= cover:
                found.append(((-covered, -known(t, first, last), -share, first, last), t))
    spans: list[tuple[int, int, int, int]] = []
    kept, taken = set(), bytearray(1 + max((rank[4] for rank, _ in found), default=0))
    for rank, t in sorted(found):
        first, last = rank[3:]
        if rank in kept or taken.find(1, first, last + 1) < 0:
            kept.add(rank)
            taken[first : last + 1] = b"\1" * (last + 1 - first)
            spans.append((t, first, last, -rank[0]))
    return sorted(spans, key=lambda s: s[1:]), best


def scan_licenses(docs: DataFrame, templates=None, base=None, least: int = 4, cover: float = 0.6) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans (json: label, first word, last word, covered words).

    Null or empty text: no words, empty labels, score 0. Null doc_id stays null; repeated rows
    each get their row. Score: 1 with a base place, else the largest share of a template that
    one chain covers. No shuffle; a text's words are the only memory that grows."""
    model = build(templates, base)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                r = scan(model, text, least, cover)
                starts = [s for s, _ in r["base"]]
                spans = [[model[1][t][0], a, b, c] for t, a, b, c in r["spans"]]
                out.append((r["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(r["base_labels"]), ",".join(r["labels"]), r["score"], json.dumps(spans)))
            frame = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    scan_udf = F.pandas_udf(run, "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string")
    return documents(docs).select("doc_id", scan_udf("text").alias("r")).select("doc_id", "r.*")
