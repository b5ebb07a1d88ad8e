"""Licence scans with a generalised suffix automaton over the words of licence templates.

The automaton knows every run of words of every template. A text is streamed through it once: at each
word it holds the longest run ending there that some template contains (the matching statistics). Runs
that cannot grow further and are long enough become matches with their places in the templates; matches
of one template in the same order are chained into spans, and a span that covers enough of its template
gives the text that label. Templates are licence notices, the sections of whole licence texts, and short
statements (names of licences, SPDX identifiers, reserved rights). How long a run and how large a share a
template asks for depends on its length: a short one has to be there whole, and is seen where a run holds it
at its end, also inside a longer run. Phrases of the base rule are counted as they stand.
"""

from __future__ import annotations

import functools
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tableworks.llm.batches import keyed, map_texts, utf8

#: The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Public licence notices (opening words), by label.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software"),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at"),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer."),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at"),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software"),
    "proprietary": "All rights reserved. No part of this publication may be reproduced",
}

#: Whole licence texts beside this module, by file name; their sections of at least so many words are templates.
WHOLE = {"Apache-2.0": "apache", "BSD": "bsd", "CC0-1.0": "cc0", "GPL-2": "gpl", "GPL-3": "gpl", "LGPL-2.1": "lgpl",
         "LGPL-3": "lgpl", "MPL-2.0": "mpl"}
LEAST_SECTION = 12

#: Names that stand for a licence wherever they are, and those that need "licensed under" or the like.
_NAMES = {
    "apache": ["apache license", "apache license version 2 0", "apache license 2 0", "apache software license"],
    "gpl": ["gnu general public license", "gnu general public license version 2", "gnu general public license version 3",
            "gnu gpl"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license", "gnu lgpl"],
    "agpl": ["gnu affero general public license", "gnu agpl"],
    "mpl": ["mozilla public license"], "epl": ["eclipse public license"], "isc": ["isc license"],
    "mit": ["mit license", "expat license"], "bsd": ["bsd license", "bsd 2 clause", "bsd 3 clause"],
    "cc0": ["cc0 1 0", "cc0 license", "creative commons zero"], "proprietary": ["all rights reserved"],
}
_WEAK = {
    "apache": ["apache", "apache 2 0"], "gpl": ["gpl", "gplv2", "gplv3"], "lgpl": ["lgpl", "lgplv2", "lgplv3"],
    "agpl": ["agpl", "agplv3"], "mpl": ["mpl"], "epl": ["epl"], "isc": ["isc"], "mit": ["mit"], "bsd": ["bsd"], "cc0": ["cc0"],
    "unlicense": ["unlicense"],
}
_VERBS = ["licensed", "released", "distributed", "published", "available", "provided", "offered", "covered", "terms"]
_CC_PARTS = {"nc": ["noncommercial", "non commercial"], "nd": ["noderivatives", "noderivs", "no derivatives"],
             "sa": ["sharealike", "share alike"]}
_SPDX = ["apache", "gpl", "lgpl", "agpl", "mpl", "epl", "isc", "mit", "bsd", "cc0", "unlicense"]


def _statements() -> dict[tuple[bytes, ...], str]:
    """Label of each statement, by its words."""
    out = {name: label for label, names in _NAMES.items() for name in names}
    for verb in _VERBS:
        for under in ("under", "under the", "under a", "under an", "of the"):
            if (verb == "terms") == (under == "of the"):
                out |= {f"{verb} {under} {name}": label for label, names in _WEAK.items() for name in names}
    out |= {f"spdx license identifier {name}": name for name in _SPDX}
    for parts in ([], ["sa"], ["nc"], ["nd"], ["nc", "sa"], ["nc", "nd"]):
        label, spelled = "-".join(["cc-by", *parts]), ["creative commons attribution"]
        for part in parts:
            spelled = [f"{a} {b}" for a in spelled for b in _CC_PARTS[part]]
        short = " ".join(["cc by", *parts])
        out |= {name: label for name in [short, f"spdx license identifier {short}", *spelled]}
    out |= {name.replace("license", "licence").replace("licenced", "licensed"): label for name, label in out.items()}
    return {tuple(name.encode().split()): label for name, label in out.items()}


def _sections() -> list[tuple[str, str]]:
    """Label and text of each section of the whole licence texts."""
    folder = Path(__file__).parent / "licences"
    return [(label, section) for name, label in WHOLE.items()
            for section in re.split(r"\n\s*\n", (folder / name).read_text())
            if len(words(section.encode())) >= LEAST_SECTION]


#: Shortest match in words, words that may be missing between chained matches, share of a template for a label.
LEAST_RUN, MOST_GAP, LEAST_COVER = 4, 8, 0.6
#: Templates of at most so many words have to be there whole.
SHORT = 10

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(data: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of a text in UTF-8: runs of digits, letters and characters above ASCII."""
    return _WORD.findall(data.lower())


class SuffixAutomaton:
    """All runs of the given sequences; a state knows the place of one of its runs in each sequence.

    ``complete`` has, for each state, the sequences of at most ``short`` items that its runs can end with, as
    (length, number), the longest first.
    """

    def __init__(self, sequences: list[list], short: int = 0):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((number, at))
        # a shorter run ends wherever the runs that continue it to the left end
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]
        own: dict[int, list[tuple[int, int]]] = {}
        for number, sequence in enumerate(sequences):
            if 0 < len(sequence) <= short:
                state = 0
                for item in sequence:
                    state = self.next[state][item]
                own.setdefault(state, []).append((len(sequence), number))
        self.complete: list[tuple] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.complete[self.link[state]]
            self.complete[state] = (*sorted(own[state], reverse=True), *above) if state in own else above

    def _new(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, state: int, word, to: int) -> int:
        """A state for the runs of ``to`` that are one word longer than those of ``state``."""
        copy = self._new(self.length[state] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = copy
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new, state = self._new(self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            to = self.next[state][word]
            self.link[new] = to if self.length[to] == self.length[state] + 1 else self._split(state, word, to)
        return new

    def matches(
        self, sequence: list, least: int, offset: int = 0,
    ) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """``(end, length, state)`` of the runs of at least ``least`` words that no template continues, and
        ``(end, length, number)`` of the short sequences that are whole, the longest for each end."""
        found, whole, state, length = [], [], 0, 0
        complete = self.complete
        for at, word in enumerate(sequence):
            if word not in self.next[state]:
                if length >= least:
                    found.append((offset + at, length, state))
                while state and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            to = self.next[state].get(word)
            if to is None:
                state = length = 0
            else:
                state, length = to, length + 1
                for size, number in complete[state]:
                    if size <= length:
                        whole.append((offset + at + 1, size, number))
                        break
        if length >= least:
            found.append((offset + len(sequence), length, state))
        return found, whole


class Scanner:
    """Templates and phrases, ready to scan texts."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        texts = [(label, words(t.encode())) for label, t in (*templates.items(), *_sections())]
        texts += [(label, list(phrase)) for phrase, label in _statements().items()]
        self.labels, self.texts = [label for label, _ in texts], [t for _, t in texts]
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.known = {w: n + 1 for n, w in enumerate(sorted({w for t in self.texts for w in t}))}
        self.automaton = SuffixAutomaton([[self.known[w] for w in t] for t in self.texts], SHORT)

    def base(self, found: list[bytes], lower: bytes) -> list[tuple[int, str]]:
        """Start and label of each place where a base phrase stands."""
        places = []
        for phrase, label in self.phrases:
            if phrase[0] not in lower:
                continue
            at = -1
            while True:
                try:
                    at = found.index(phrase[0], at + 1)
                except ValueError:
                    break
                if found[at:at + len(phrase)] == phrase:
                    places.append((at, label))
        return sorted(places)

    def spans(self, found: list[bytes]) -> list[tuple[str, int, int, float]]:
        """``label, start, end, cover`` of chained template spans, by word; the best cover of each chain."""
        known = self.known
        codes = np.fromiter((known.get(w, 0) for w in found), np.int32, len(found))
        # only runs of template words can match
        edges = np.flatnonzero(np.diff(np.concatenate([[0], codes > 0, [0]]).astype(np.int8)))
        chains: dict[int, list[list[int]]] = {}
        whole: list[tuple[int, int, int]] = []
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start < 2:
                continue
            runs, short = self.automaton.matches(codes[start:end].tolist(), LEAST_RUN, start)
            whole += short
            for stop, length, state in runs:
                places: dict[int, list[int]] = {}
                # what the run ends with may stand in templates that do not have all of it
                while length >= LEAST_RUN:
                    new: dict[int, list[int]] = {}
                    for template, last in self.automaton.ends[state]:
                        if template not in places and len(self.texts[template]) > SHORT:
                            new.setdefault(template, []).append(last)
                    for template, lasts in new.items():
                        self._chain(chains.setdefault(template, []), stop - length, stop, length, sorted(lasts))
                    places |= new
                    state = self.automaton.link[state]
                    length = self.automaton.length[state]
        # of short templates inside each other the longest stays
        reached = len(found) + 1
        for stop, length, template in sorted(whole, key=lambda w: (-w[0], -w[1])):
            if stop - length < reached:
                reached = stop - length
                self._chain(chains.setdefault(template, []), reached, stop, length, [length - 1])
        out = []
        for template, chain in chains.items():
            size = len(self.texts[template])
            for start, end, _, covered in chain:
                cover = covered / size
                if cover >= (1.0 if size <= SHORT else LEAST_COVER):
                    out.append((self.labels[template], start, end, cover))
        return sorted(out)

    def _chain(self, chain: list[list[int]], start: int, end: int, length: int, lasts: list[int]) -> None:
        """Add a match to the last chain of its template if it goes on there, else begin a new one."""
        if chain:
            tail = chain[-1]
            for last in lasts:
                first = last - length + 1
                if 0 < last - tail[2] and first - tail[2] <= MOST_GAP + 1 and start - tail[1] <= MOST_GAP:
                    # words of the template that the chain holds already count once
                    tail[3] += min(length, last - tail[2])
                    tail[1], tail[2] = end, last
                    return
        chain.append([start, end, lasts[0], length])

    def scan(self, data: bytes) -> tuple:
        """The output columns of one text."""
        lower = data.lower()  # of bytes: A-Z only
        found = _WORD.findall(lower)
        base, spans = self.base(found, lower), sorted(set(self.spans(found)))
        labels = {x[1] for x in base}
        score = max([0.5 if base else 0.0, *(x[3] for x in spans)])
        return (len(found), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in spans})), min(1.0, score),
                ",".join(f"{a}:{b}:{c}" for a, b, c, _ in spans))


@functools.cache
def scanner() -> Scanner:
    """One automaton for each Python worker."""
    return Scanner()


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    spans``.

    ``spans`` lists the covered template spans as label:first word:end. ``score`` is the largest share of
    a template or statement that a span covers, at least 0.5 where a base phrase stands, else 0. A null or empty text
    has no words, no labels (empty strings) and null places. Repeated rows are scanned each; a null
    identifier stays null; an empty table gives an empty result; other columns are ignored.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def scan(batch):
        rows = [scanner().scan(data) for data in utf8(batch, "text")]
        columns = list(zip(*rows)) or [()] * len(names)
        return {"doc_id": batch.column("doc_id")} | dict(zip(names, columns))

    return map_texts(keyed(docs, id_col, text_col), scan,
                     "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                     "base_labels string, labels string, score double, spans string")
