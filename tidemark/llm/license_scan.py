"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

The templates' word triples are hashed and winnowed: of every ``WINNOW`` neighbouring
triples the least is a fingerprint, kept in an inverted index with its template and
place. The templates are a fixed list, so the index is bounded and goes to every task.
All triples of a document are looked up, so any stretch of ``WINNOW + GRAM - 1`` words
shared with a template is found. Hits that lie within a band of one diagonal are a candidate; a
local alignment within the band gives the words matched and the span. Once a match is taken,
candidates that overlap it are aligned again over the words that it leaves free, as long as
these hold a hit, so that occurrences within one band are all found.

A match is reported with its coverage, the matched share of the template's words, from
``COVERAGE`` on; of overlapping matches of one template the best one, the first of
equals.

Defined results: a null or empty text has no match and no row; repeated rows give repeated
matches; a null doc_id stays null; an empty table gives an empty result; other columns
than doc_id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shingles import windows, word_hashes

GRAM, WINNOW = 3, 2
BAND = 8
COVERAGE = 0.6

# License notices as their authors publish them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def normal_words(text: bytes | None) -> list[bytes]:
    return _WORD.findall(text.lower()) if text else []


def winnowed(grams: np.ndarray) -> list[int]:
    """Places of the fingerprints: the last least gram of every window, or of all if there are fewer."""
    size = min(WINNOW, len(grams))
    return sorted({at + size - 1 - int(np.argmin(grams[at : at + size][::-1])) for at in range(len(grams) - size + 1) if size})


def aligned(template: list[bytes], doc: list[bytes], diagonal: int) -> tuple[int, int, int, int]:
    """Score, matched words, first and last document word of the best local alignment in the band.

    A match scores 2; a word replaced, left out or put in costs 1.
    """
    best = (0, 0, 0, -1)
    above: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, diagonal + i - BAND), min(len(doc), diagonal + i + BAND + 1)):
            score, matched, first = above.get(j - 1, (0, 0, j))
            same = word == doc[j]
            cell = (score + 2, matched + 1, first if score else j) if same else (score - 1, matched, first)
            for other in (above.get(j), row.get(j - 1)):
                if other and other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            if cell[0] > 0:
                row[j] = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], j)
        above = row
    return best


class Index:
    """The inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {name: normal_words(text.encode()) for name, text in templates.items()}
        self.postings: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for name, found in self.words.items():
            if found:
                grams = windows(word_hashes(found), min(GRAM, len(found)))
                for at in winnowed(grams):
                    self.postings[int(grams[at])].append((name, at))
        self.known = np.array(sorted(self.postings), dtype=np.uint64)

    def matches(self, text: bytes | None, coverage: float) -> list[tuple[str, int, int, int, float]]:
        """(template, first word, last word, matched words, coverage), in order."""
        found = normal_words(text)
        if len(found) < GRAM or not len(self.known):
            return []
        grams = windows(word_hashes(found), GRAM)
        at = np.searchsorted(self.known, grams)
        at[at == len(self.known)] = 0
        bands: dict[str, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for place in map(int, np.flatnonzero(self.known[at] == grams)):
            for name, offset in self.postings[int(grams[place])]:
                bands[name][(place - offset) // BAND].append((place, place - offset))
        kept = [(name, *match) for name, hits in bands.items() for match in self._best(name, found, hits, coverage)]
        return sorted(kept, key=lambda k: (k[1], k[2], k[0]))

    def _best(
        self, name: str, found: list[bytes], bands: dict[int, list[tuple[int, int]]], coverage: float
    ) -> list[tuple[int, int, int, float]]:
        """The matches of one template, best first, none overlapping another; hits of a band are (place, diagonal)."""
        template = self.words[name]

        def proposed(band: int, low: int, high: int) -> tuple[int, ...] | None:
            hits = bands[band]
            k = bisect_left(hits, (low,))
            if k == len(hits) or hits[k][0] + GRAM > high:
                return None
            score, matched, first, last = aligned(template, found[low:high], hits[k][1] - low)
            if not score or matched < coverage * len(template):
                return None
            return -score, first + low, last + low, matched, band, low, high

        whole = ((k, max(0, k * BAND - BAND), min(len(found), (k + 2) * BAND + len(template))) for k in bands)
        queue = [p for p in (proposed(*w) for w in whole) if p]
        heapify(queue)
        taken: list[tuple[int, int]] = []
        kept = []
        while queue:
            _, first, last, matched, band, low, high = heappop(queue)
            at = bisect_left(taken, (first,))
            if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or taken[at][0] > last):
                insort(taken, (first, last))
                kept.append((first, last, matched, matched / len(template)))
            # What the matches taken leave free of the words that were aligned.
            free, at = low, max(0, bisect_left(taken, (low,)) - 1)
            gaps = []
            while at < len(taken) and taken[at][0] < high:
                gaps.append((free, taken[at][0]))
                free, at = max(free, taken[at][1] + 1), at + 1
            for start, end in [*gaps, (free, high)]:
                again = proposed(band, start, end) if end - start >= GRAM else None
                if again:
                    heappush(queue, again)
        return kept


def _scan(templates: dict[str, str], coverage: float):
    names = ["doc_id", "template", "start", "end", "matched_words", "coverage"]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            rows, out = [], []
            for row, value in enumerate(batch.column(1)):
                text = value.as_py()
                found = index.matches(text, coverage)
                if found:
                    spans = [m.span() for m in _WORD.finditer(text.lower())]
                    # Bytes to code points.
                    place = lambda at, t=text: len(t[:at].decode(errors="replace"))
                    for name, first, last, matched, share in found:
                        rows.append(row)
                        out.append((name, place(spans[first][0]), place(spans[last][1]), matched, share))
            columns = [[x[k] for x in out] for k in range(5)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return of_batches


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, template, start, end, matched_words, coverage) of every match; places in code points."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, template string, start bigint, end bigint, matched_words bigint, coverage double"
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(_scan(TEMPLATES if templates is None else templates, coverage), schema)
