"""License scans: known sentences, and rules that are ordered sequences of them.

A text's sentences are normalised and mapped to identifiers of known licence
sentences; the identifiers found, in order, are matched against the rules.  The
sentences and rules are a table of fixed size that each task holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tabloom.llm import shared

#: Rules: (licence, sentences in order).  A rule matches where its sentences follow each other with small gaps.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["Released under the MIT License"]),
    ("MIT", ["Licensed under the MIT License"]),
    ("MIT", ["This project is licensed under the MIT License"]),
    ("MIT", [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ]),
    ("Apache-2.0", ["Licensed under the Apache License, Version 2.0"]),
    ("Apache-2.0", ["Licensed under the Apache License, Version 2.0 (the \"License\")", "you may not use this file except in compliance with the License"]),
    ("GPL-2.0", ["This work is licensed under the GNU General Public License, version 2"]),
    ("GPL-3.0", ["This work is licensed under the GNU General Public License, version 3"]),
    ("GPL-3.0-or-later", [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    ]),
    ("GPL-2.0-or-later", [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    ]),
    ("LGPL-2.1", ["This work is licensed under the GNU Lesser General Public License, version 2.1"]),
    ("LGPL-2.1-or-later", [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    ]),
    ("CC-BY-NC-SA-4.0", ["Licensed under CC BY-NC-SA 4.0"]),
    ("CC-BY-NC-ND-4.0", ["Licensed under CC BY-NC-ND 4.0"]),
    ("LGPL-3.0", ["This work is licensed under the GNU Lesser General Public License, version 3"]),
    ("AGPL-3.0", ["This work is licensed under the GNU Affero General Public License, version 3"]),
    ("CC-BY-4.0", ["Licensed under CC BY 4.0"]),
    ("CC-BY-SA-4.0", ["Licensed under CC BY-SA 4.0"]),
    ("CC-BY-NC-4.0", ["Licensed under CC BY-NC 4.0"]),
    ("CC-BY-ND-4.0", ["Licensed under CC BY-ND 4.0"]),
    ("CC-BY-4.0", ["This work is licensed under a Creative Commons Attribution 4.0 International License"]),
    ("CC0-1.0", ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"]),
    ("BSD-3-Clause", [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ]),
    ("BSD-2-Clause", [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ]),
    ("ISC", ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"]),
    ("MPL-2.0", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"]),
    ("Unlicense", ["This is free and unencumbered software released into the public domain"]),
    ("all-rights-reserved", ["All rights reserved"]),
]

_WORD = re.compile(r"[a-z0-9]+")
_ANY = re.compile(r"[A-Za-z0-9]+")
#: Ends of sentences: marks before white space, empty lines, line ends of headings and list items.
_END = re.compile(r"(?<=[.!?;:])[\"')\]]*\s+|\n\s*\n|(?<=[.!?;:])\Z")
_LINE = re.compile(r"\n")


def normalise(sentence: str) -> str:
    """Lower-case letters and digits, joined by one space."""
    return " ".join(_WORD.findall(sentence.lower()))


class Scanner:
    """Sentences and rules, ready for texts."""

    def __init__(self, rules: list[tuple[str, list[str]]] = RULES, gap: int = 3):
        self.ids: dict[str, int] = {}
        self.rules: list[tuple[str, tuple[int, ...]]] = []
        for name, sentences in rules:
            parts = [normalise(p) for s in sentences for _, _, p in _pieces(s)]
            self.rules.append((name, tuple(self.ids.setdefault(p, len(self.ids)) for p in parts if p)))
        self.gap = gap
        # a text without the longest word of any known sentence holds none of them
        words = {max(s.split(), key=lambda w: (len(w), w)) for s in self.ids}
        self.hint = re.compile("|".join(sorted(words)))
        # known sentences by their first words, the longest first: a piece may hold them after and before other words
        self.starts: dict[str, list[tuple[list[str], int]]] = {}
        for sentence, key in sorted(self.ids.items(), key=lambda x: -len(x[0].split())):
            parts = sentence.split()
            if len(parts) < 3:  # a rest such as "2.0" says nothing among other words
                continue
            self.starts.setdefault(parts[0], []).append((parts, key))

    def sentences(self, text: str) -> list[tuple[int, int, int, int]]:
        """(sentence number, id, start, end) of the known sentences: whole pieces, lines, and runs of words within a piece, over line ends too."""
        found = {}
        number = 0
        for start, end, part in _pieces(text):
            number += 1
            key = self.ids.get(normalise(part))
            if key is not None:
                found[start] = (number, key, start, end)
                continue
            at = start
            lines: list[tuple[int, int]] = []
            for line in part.split("\n") if "\n" in part else []:
                key = self.ids.get(normalise(line))
                if key is not None:
                    found[at] = (number, key, at, at + len(line))
                    lines.append((at, at + len(line)))
                at += len(line) + 1
            if self.hint.search(part.lower()):
                for key, a, b in self._runs(part):
                    if not any(x < start + b and start + a < y for x, y in lines):
                        found[start + a] = (number, key, start + a, start + b)
        return [found[k] for k in sorted(found)]

    def _runs(self, part: str) -> Iterator[tuple[int, int, int]]:
        """(id, start, end) of known sentences that are runs of words of a piece, from the left, of those that begin at a word the longest."""
        places = [m.span() for m in _WORD.finditer(part.lower())] if len(part.lower()) == len(part) else [m.span() for m in _ANY.finditer(part)]
        words = [part[a:b].lower() for a, b in places]
        i = 0
        while i < len(words):
            hit = next(((p, key) for p, key in self.starts.get(words[i], ()) if words[i : i + len(p)] == p), None)
            if hit is None:
                i += 1
                continue
            last = i + len(hit[0]) - 1
            yield hit[1], places[i][0], places[last][1]
            i = last + 1

    def scan(self, text: str | None) -> tuple[list[tuple[str, int, int]], int]:
        """(matches as (licence, start, end), number of known sentences); of rules that match the same place, the longest hold."""
        if not text or not self.hint.search(text.lower()):
            return [], 0
        known = self.sentences(text)
        spans = []
        for name, ids in self.rules:
            i = 0
            while i < len(known):
                j, step = i, 0
                last = i
                while j < len(known) and step < len(ids) and known[j][0] - known[last][0] <= self.gap:
                    if known[j][1] == ids[step]:
                        last, step = j, step + 1
                    elif step == 0:
                        break
                    j += 1
                if step == len(ids):
                    spans.append((i, last, name, len(ids)))
                    i = last + 1
                else:
                    i += 1
        whole = [s for s in spans if not any(o is not s and o[0] <= s[0] and s[1] <= o[1] and o[3] > s[3] for o in spans)]
        return sorted({(name, known[i][2], known[j][3]) for i, j, name, _ in whole}, key=lambda x: (x[1], x[0])), len(known)


def _pieces(text: str) -> Iterator[tuple[int, int, str]]:
    at = 0
    for m in _END.finditer(text):
        if m.start() > at:
            yield at, m.start(), text[at : m.start()]
        at = m.end()
    if at < len(text):
        yield at, len(text), text[at:]


def scan(docs: DataFrame, rules: list[tuple[str, list[str]]] = RULES, gap: int = 3) -> DataFrame:
    """doc_id, licenses (sorted), n_sentences (known ones) and hits (license, start, end) of each document (doc_id, text).

    start and end count characters of the text.  Null and empty texts have no hits; a
    null doc_id stays null; repeated rows give a row each; very long texts are read
    whole; an empty table gives no rows; other columns are not read.  Rules that
    match in the same place are all given, but not one that is part of a longer one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, gap)
        for batch in batches:
            found = [scanner.scan(text) for text in batch.column(1).to_pylist()]
            hits = pa.array([[{"license": a, "start": b, "end": c} for a, b, c in x] for x, _ in found], pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            names = pa.array([sorted({a for a, _, _ in x}) for x, _ in found], pa.list_(pa.string()))
            yield pa.record_batch([batch.column(0), names, pa.array([n for _, n in found], pa.int64()), hits], ["doc_id", "licenses", "n_sentences", "hits"])

    return shared.mapped(docs.select("doc_id", "text"), run, "doc_id long, licenses array<string>, n_sentences long, hits array<struct<license:string,start:long,end:long>>")
