"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every substring of every template and phrase. A text's words are streamed through it;
after each word it gives the longest suffix of the text read so far that stands in a template (the matching
statistics). Matches that can't be extended and are long enough are chained, in order of text and template,
into spans; the share of a template that a chain covers decides on its label. Phrases are read off the
automaton's states, so all their places are found whatever the length of the match they stand in.

Words are mapped to token ids by their bytes first; words of no template reset the automaton, so only runs of
template words, as long as the shortest phrase, are streamed. Work is linear in the text, and a document's matches are
all it keeps.

Defined results: null or empty text has no words, no labels and score 0; a very long text is scanned whole; of
overlapping phrases every place counts, and of chains of equal share the label first in order comes first; repeated
rows give repeated results; an empty table gives none; a null key stays null; no other column is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from webloom.llm import _text

#: Phrases whose every place counts, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Passages of public licence texts and usual notices: (label, text).
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("gpl-3.0", "this work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


@dataclass
class Automaton:
    """A generalised suffix automaton over lists of token ids."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: (template, position after its last token) of the places of a state's strings; one place a template.
    places: list[dict[int, int]] = field(default_factory=lambda: [{}])

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.places.append({})
        return len(self.next) - 1

    def _split(self, above: int, token: int) -> int:
        """The state of ``above``'s longest string and ``token``; a clone if that isn't a state's longest."""
        old = self.next[above][token]
        if self.length[old] == self.length[above] + 1:
            return old
        clone = self._state(self.length[above] + 1, self.link[old], dict(self.next[old]))
        self.places[clone] = dict(self.places[old])
        self.link[old] = clone
        while above != -1 and self.next[above].get(token) == old:
            self.next[above][token] = clone
            above = self.link[above]
        return clone

    def add(self, template: int, tokens: list[int]) -> None:
        last = 0
        for i, token in enumerate(tokens):
            if token in self.next[last]:
                last = self._split(last, token)
            else:
                new, at = self._state(self.length[last] + 1, 0, {}), last
                while at != -1 and token not in self.next[at]:
                    self.next[at][token] = new
                    at = self.link[at]
                if at != -1:
                    self.link[new] = self._split(at, token)
                last = new
            up = last
            while up > 0:
                self.places[up].setdefault(template, i + 1)
                up = self.link[up]

    def find(self, tokens: list[int]) -> int:
        at = 0
        for token in tokens:
            at = self.next[at][token]
        return at


class Scanner:
    """Templates and phrases as an automaton, and the scan of one block of documents."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match: int = 3, coverage: float = 0.75, gap: int = 8):
        self.labels = [k for k, _ in templates]
        texts = [words_of(t) for _, t in templates] + [words_of(p) for p in phrases]
        self.sizes = [len(t) for t in texts]
        words = sorted({w for t in texts for w in t})
        self.words, ids = pa.array(words, pa.binary()), {w: i for i, w in enumerate(words)}
        self.automaton = Automaton()
        for i, t in enumerate(texts):
            self.automaton.add(i, [ids[w] for w in t])
        self.n_templates, self.min_match, self.coverage, self.gap = len(templates), min_match, coverage, gap
        self.phrase_labels = list(phrases.values())
        #: Runs of fewer known words hold no phrase.
        self.least_run = max(1, min([2, *self.sizes[self.n_templates :]]))
        ends_at: dict[int, list[int]] = {}
        for i, t in enumerate(texts[self.n_templates :]):
            ends_at.setdefault(self.automaton.find([ids[w] for w in t]), []).append(i)
        #: Of each state, the phrases that are suffixes of its strings, as (words, phrase).
        self.phrases: list[list[tuple[int, int]]] = []
        for s in range(len(self.automaton.next)):
            got, up = [], s
            while up > 0:
                got += [(self.sizes[self.n_templates + i], i) for i in ends_at.get(up, ())]
                up = self.automaton.link[up]
            self.phrases.append(got)

    def _runs(self, block: _text.Block):
        low = _text.LOWER[block.buf]
        starts, ends, bounds = _text.word_spans(low, block.offs, _text.ALNUM)
        at = pc.index_in(_text.word_array(low, starts, ends), value_set=self.words)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy()
        before = np.zeros(len(known), bool)
        before[1:] = known[:-1]
        first = np.zeros(len(known), bool)
        first[bounds[:-1][bounds[:-1] < len(known)]] = True
        begins = np.flatnonzero(known & (~before | first))
        after = np.zeros(len(known), bool)
        after[:-1] = known[1:] & ~first[1:]
        stops = np.flatnonzero(known & ~after) + 1
        long = stops - begins >= self.least_run
        return at, begins[long], stops[long], bounds

    def scan(self, block: _text.Block) -> list[dict]:
        """For each document: words, places of phrases [(start, phrase)], spans [(label, start, end, share)]."""
        tokens, begins, stops, bounds = self._runs(block)
        out = [{"n_words": n, "places": [], "spans": []} for n in np.diff(bounds).tolist()]
        docs = np.searchsorted(bounds, begins, "right") - 1
        auto, phrases, least = self.automaton, self.phrases, self.min_match
        follow, link, length = auto.next, auto.link, auto.length
        matches: dict[int, list] = {}
        for doc, a, b in zip(docs.tolist(), begins.tolist(), stops.tolist(), strict=True):
            zero, state, size = int(bounds[doc]), 0, 0
            for i, token in enumerate(tokens[a:b].tolist(), a - zero):
                held, was = state, size
                while state and token not in follow[state]:
                    state = link[state]
                    size = length[state]
                if token in follow[state]:
                    state = follow[state][token]
                    size += 1
                else:
                    size = 0
                if size <= was and was >= least:
                    matches.setdefault(doc, []).append((i - was, i, held))
                for n, p in phrases[state]:
                    if n <= size:
                        out[doc]["places"].append((i + 1 - n, p))
            if size >= least:
                matches.setdefault(doc, []).append((b - zero - size, b - zero, state))
        for doc, found in matches.items():
            out[doc]["spans"] = self._chained(found)
        return out

    def _chained(self, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains of matches that follow each other in the text and in a template, in one pass."""
        open_: dict[int, list[int]] = {}
        spans: list[tuple[str, int, int, float]] = []

        def close(t: int) -> None:
            start, end, _, covered = open_.pop(t)
            spans.append((self.labels[t], start, end, covered / self.sizes[t]))

        for start, end, state in found:
            for t, t_end in self.automaton.places[state].items():
                if t >= self.n_templates:
                    continue
                t_start = t_end - (end - start)
                if t in open_:
                    c = open_[t]
                    cut = max(0, c[1] - start, c[2] - t_start)
                    if start - c[1] <= self.gap and t_start >= c[2] - (end - start) and t_end > c[2] and cut < end - start:
                        open_[t] = [c[0], end, t_end, c[3] + end - start - cut]
                        continue
                    if end - start <= c[3] and end <= c[1]:
                        continue
                    close(t)
                open_[t] = [start, end, t_end, end - start]
        for t in list(open_):
            close(t)
        return sorted(s for s in spans if s[3] >= self.coverage)


def scan_licenses(
    df: DataFrame, key: str = "doc_id", text: str = "text", *, templates=TEMPLATES, phrases=PHRASES, min_match: int = 3, coverage: float = 0.75, gap: int = 8
) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans). ``spans`` are the
    chains that cover at least ``coverage`` of a template: label, first word, word after the last, share.
    The score is the largest share, or 0.5 where there are places of phrases only."""
    scanner = Scanner(templates, phrases, min_match, coverage, gap)
    kind = dict(df.dtypes)[key]

    def work(block: _text.Block) -> dict:
        found = scanner.scan(block)
        starts = [[s for s, _ in d["places"]] for d in found]
        base = [{scanner.phrase_labels[p] for _, p in d["places"]} for d in found]
        own = [{s[0] for s in d["spans"]} for d in found]
        return {
            "key": block.columns["key"],
            "n_words": [d["n_words"] for d in found],
            "n_base": [len(s) for s in starts],
            "first_word": [min(s, default=None) for s in starts],
            "last_word": [max(s, default=None) for s in starts],
            "base_labels": [",".join(sorted(b)) for b in base],
            "labels": [",".join(sorted(b | o)) for b, o in zip(base, own, strict=True)],
            "score": [max([0.5 * bool(s), *(min(1.0, x[3]) for x in d["spans"])]) for s, d in zip(starts, found, strict=True)],
            "spans": [[dict(zip(("label", "first_word", "end_word", "share"), s, strict=True)) for s in d["spans"]] for d in found],
        }

    schema = f"key {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,share:double>>"
    return _text.map_blocks(df, {"key": key, "text": text}, work, schema).withColumnRenamed("key", key)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_licenses(docs).drop("spans")
