"""License scans: winnowed fingerprints of templates pick candidates, banded alignment judges them.

Templates are cut into words; of every ``SPAN`` grams of ``GRAM`` words the one with the smallest
hash is a fingerprint, and an inverted index leads from it to its places in templates. The index
is made of the templates alone, a parameter, so its size is bounded and every task holds it.
Documents are winnowed alike, as arrays; the hits of a template that lie on nearly the same
diagonal are one candidate. Each candidate is aligned with the words around it inside a band
(matches score, gaps and changes cost), which gives the matched coverage, the share of the
template's words that are found, and the span in the document. Of overlapping spans the one with
the larger coverage, then more matched words, then the earlier name, stays.

Templates of fewer words than a winnowing window have all their grams as fingerprints.

Defined cases: null or empty text has no matches; repeated rows are each scanned; a null doc_id
is kept; templates without words never match; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecare.llm.common import documents, text_of

GRAM, SPAN = 3, 3
#: The least share of a template's words that is a match.
COVERAGE = 0.8
#: How far an alignment may stray from its diagonal, as a share of the template's words, and at least.
BAND, LEAST_BAND = 0.15, 3
#: Words from which on a template is a whole license, and cells from which on rows are aligned as arrays.
LONG, CELLS = 100, 2000
WORD = regex.compile(r"[\p{L}\p{N}]+(?:[.\-+][\p{L}\p{N}]+)*")

#: Whole licenses, as they are published, in the folder license_texts.
TEXTS = [
    "Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0",
    "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0",
]

#: Public notices by which works state their license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Affero General Public License as published by the Free Software Foundation, either version 3 of the License"
    ),
    "BSD": "Released under the BSD License.",
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0"
    ),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License"
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
} | {
    f"CC-{kind}-{version}": f"Licensed under CC {kind} {version}."
    for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
    for version in ("3.0", "4.0")
}
#: What is scanned for: the notices and the whole licenses.
LICENSES = TEMPLATES | {
    f"{name}-text": resources.files("tablecare.llm").joinpath("license_texts", f"{name}.txt").read_text("utf-8")
    for name in TEXTS
}


def _versions(name: str, *versions: str) -> tuple[str, ...]:
    return tuple(f"{name} {v}" for x in versions for v in (f"version {x}", f"v{x}", f"v {x}", x))


#: Runs of words of which one must stand in the span of a template's match.
NAMES = {
    "AGPL-3.0": _versions("gnu affero general public license", "3", "3.0"),
    "AGPL-3.0-header": ("gnu affero general public license",),
    "Apache-2.0": _versions("apache license", "2.0", "2"),
    "Apache-2.0-header": _versions("apache license", "2.0", "2"),
    "BSD": ("bsd",),
    "BSD-2-Clause-text": ("provided with the distribution this software is provided",),
    "BSD-3-Clause-text": ("endorse or promote products derived from this software",),
    "EPL-2.0": _versions("eclipse public license", "2.0", "2"),
    "GFDL-1.2-text": _versions("gnu free documentation license", "1.2"),
    "GFDL-1.3-text": _versions("gnu free documentation license", "1.3"),
    "GPL-2.0": _versions("gnu general public license", "2", "2.0"),
    "GPL-3.0": _versions("gnu general public license", "3", "3.0"),
    "GPL-header": ("gnu general public license",),
    "GPL-3.0-text": (
        *_versions("gnu general public license", "3", "3.0"),
        "the gnu general public license is a free copyleft license",
        "use with the gnu affero general public license",
    ),
    "ISC-text": ("provided that the above copyright notice",),
    "LGPL-2.0-text": ("gnu library general public license",),
    "LGPL-2.1": _versions("gnu lesser general public license", "2.1"),
    "LGPL-2.1-header": ("gnu lesser general public license",),
    "LGPL-2.1-text": ("gnu lesser general public license",),
    "LGPL-3.0": _versions("gnu lesser general public license", "3", "3.0"),
    "LGPL-3.0-text": ("gnu lesser general public license",),
    "MIT": ("mit",),
    "MIT-text": ("the above copyright notice and this permission notice",),
    "MPL-2.0": ("mozilla public license",),
    "Unlicense": ("free and unencumbered software",),
} | {name: (text.removeprefix("Licensed under ").rstrip("."),) for name, text in TEMPLATES.items() if name[:3] == "CC-"}

POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, from the polynomial over its lower-cased bytes."""
    raw = [w.lower().encode() for w in words]
    if not raw:
        return np.empty(0, np.uint64)
    sizes = np.array([len(x) for x in raw])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    top = int(sizes.max())
    power = np.cumprod(np.full(top, 0x100000001B3, np.uint64))
    return _mixed(np.add.reduceat(data * power[inside], np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def fingerprints(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed grams: their hashes and first words. All grams, if there are fewer than ``SPAN``."""
    n = len(hashes) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = _mixed(sum(hashes[k : n + k] * POWERS[k] for k in range(GRAM)))
    if n <= SPAN:
        return grams, np.arange(n)
    windows = np.lib.stride_tricks.sliding_window_view(grams, SPAN)
    places = np.unique(windows.argmin(1) + np.arange(len(windows)))
    return grams[places], places


class Index:
    """Templates and the inverted index of their fingerprints.

    Documents and templates are winnowed the same way, so any ``GRAM + SPAN - 1`` words in common
    share a fingerprint; grams at the ends of a template, where a document's window reaches
    beyond it, are all indexed.
    """

    def __init__(self, templates: dict[str, str], names: dict[str, tuple[str, ...]] = NAMES):
        self.words = {name: word_hashes(WORD.findall(text)) for name, text in templates.items()}
        self.bags = {name: np.unique(hashes, return_counts=True) for name, hashes in self.words.items()}
        runs = {name: [word_hashes(WORD.findall(x)) for x in names.get(name, ())] for name in templates}
        # Names are for the template that holds them; another text under that name needs none.
        self.names = {name: r for name, r in runs.items() if any(has_run(self.words[name], x) for x in r)}
        places: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for name, hashes in self.words.items():
            n = max(0, len(hashes) - GRAM + 1)
            prints, at = fingerprints(hashes)
            chosen = dict(zip(at.tolist(), prints.tolist()))
            every = _mixed(sum(hashes[k : n + k] * POWERS[k] for k in range(GRAM))) if n else np.empty(0, np.uint64)
            for i in {*range(min(n, SPAN - 1)), *range(max(0, n - SPAN + 1), n)}:
                chosen[i] = int(every[i])
            for i, value in chosen.items():
                places[value].append((name, i))
        self.places = dict(places)
        self.keys = np.array(sorted(self.places), np.uint64)

    def named(self, name: str, span: np.ndarray) -> bool:
        """Whether a span holds one of the runs that tell the license from its like."""
        return name not in self.names or any(has_run(span, run) for run in self.names[name])

    def most(self, name: str, window: np.ndarray) -> int:
        """How many of the template's words a window has, whatever their order."""
        values, counts = self.bags[name]
        found, times = np.unique(window, return_counts=True)
        _, a, b = np.intersect1d(values, found, assume_unique=True, return_indices=True)
        return int(np.minimum(counts[a], times[b]).sum())

    def candidates(self, hashes: np.ndarray, coverage: float = 0.0) -> list[tuple[str, int]]:
        """Templates that may fit and the word of the document where they would begin; near ones are one."""
        prints, at = fingerprints(hashes)
        if not len(prints) or not len(self.keys):
            return []
        found = np.minimum(np.searchsorted(self.keys, prints), len(self.keys) - 1)
        by_template: dict[str, list[int]] = defaultdict(list)
        for i in np.flatnonzero(self.keys[found] == prints).tolist():
            for name, place in self.places[int(prints[i])]:
                by_template[name].append(int(at[i]) - place)
        out = []
        for name, starts in by_template.items():
            if len(hashes) < coverage * len(self.words[name]):
                continue
            near: list[list[int]] = []
            for start in sorted(starts):
                if not near or start - near[-1][0] > band_of(len(self.words[name])):
                    near.append([])
                near[-1].append(start)
            if len(self.words[name]) >= LONG:
                near.sort(key=lambda x: -len(x))
            out += [(name, x[0]) for x in near]
        return out


def has_run(words: np.ndarray, run: np.ndarray) -> bool:
    n = len(words) - len(run) + 1
    return n > 0 and bool(np.logical_and.reduce([words[k : n + k] == x for k, x in enumerate(run)]).any())


def band_of(size: int) -> int:
    return max(LEAST_BAND, int(BAND * size))


def align(template: np.ndarray, text: np.ndarray, start: int, band: int) -> tuple[int, int, int]:
    """Matched words, and first word and end of the span, of the best alignment near a diagonal.

    The whole template is aligned with any part of the text: a match scores 2, every gap or
    change costs 1, and template words left out at either end cost 1 each.
    """
    low, width = start - band, 2 * band + 1
    none = -(10**9)
    if len(template) * width >= CELLS:
        row = _last_row(template, text, low, width, none)
        return _span(template, text, low, width, row, none)
    # Cell (i, k): i template words used, text up to low + i + k. Holds score, matches, first word.
    row = [(0, 0, low + k) if 0 <= low + k <= len(text) else (none, 0, 0) for k in range(width)]
    for i, word in enumerate(template.tolist()):
        new = []
        for k in range(width):
            j = low + i + k
            best = (none, 0, 0)
            if 0 <= j < len(text):
                s, m, first = row[k]
                same = int(text[j]) == word
                best = (s + 2, m + 1, first if m else j) if same else (s - 1, m, first)
            if k + 1 < width:
                s, m, first = row[k + 1]
                best = max(best, (s - 1, m, first), key=lambda x: x[:2])
            if k and 0 <= j < len(text):
                s, m, first = new[k - 1]
                best = max(best, (s - 1, m, first), key=lambda x: x[:2])
            new.append(best)
        row = new
    return _span(template, text, low, width, row, none)


def _span(template: np.ndarray, text: np.ndarray, low: int, width: int, row: list, none: int) -> tuple[int, int, int]:
    k = max(range(width), key=lambda k: (row[k][:2], -k))
    score, matches, first = row[k]
    end = min(len(text), max(first, low + len(template) + k))
    while end > first and int(text[end - 1]) not in template:
        end -= 1
    return (matches, first, end) if score > none // 2 else (0, 0, 0)


def _last_row(template: np.ndarray, text: np.ndarray, low: int, width: int, none: int) -> list[tuple[int, int, int]]:
    """The last row of ``align``, a row of cells at a time: scores and matches are one number, score first."""
    unit, k = 1 << 20, np.arange(width)
    at = low + k
    inside = (at >= 0) & (at <= len(text))
    value, first = np.where(inside, 0, none * unit), np.where(inside, at, 0)
    padded = np.concatenate([text, np.zeros(1, text.dtype)])
    for i, word in enumerate(template):
        j = low + i + k
        there = (j >= 0) & (j < len(text))
        same = padded[np.where(there, j, len(text))] == word
        diagonal = np.where(there, value + np.where(same, 2 * unit + 1, -unit), none * unit)
        # Matches are the low part; none so far means that the span begins here.
        begun = np.where(same & (value & (unit - 1) == 0), j, first)
        down = np.append(value[1:] - unit, none * unit * 2)
        better = down > diagonal
        own, begun = np.where(better, down, diagonal), np.where(better, np.append(first[1:], 0), begun)
        # Gaps along the row: the best cell before, less one for each step, but not over cells outside the text.
        own = np.where(there | (own > none * unit // 2), own, none * unit)
        level = own + k * unit
        best = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == best, k, 0))
        source = np.where(there, source, k)
        value, first = own[source] - (k - source) * unit, begun[source]
    return [(int(v) >> 20, int(v) & (unit - 1), int(f)) for v, f in zip(value, first)]


def scan(index: Index, text: str, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, first and end character) of the matches in a text."""
    hashes = word_hashes(WORD.findall(text))
    matches = []
    for name, start in index.candidates(hashes, coverage):
        template = index.words[name]
        # The middle of a whole license that lies in one already found: the same copy, by fewer hits.
        middle = start + len(template) // 2
        if len(template) >= LONG and any(m[0] == name and m[3] <= middle < m[4] for m in matches):
            continue
        band = band_of(len(template))
        if index.most(name, hashes[max(0, start - band) : start + len(template) + band]) < coverage * len(template):
            continue
        n, first, end = align(template, hashes, start, band)
        # A version may stand just behind the last word that matches.
        if n and n / len(template) >= coverage and index.named(name, hashes[first : end + 2]):
            matches.append((name, n / len(template), n, first, end))
    kept: list[tuple[str, float, int, int, int]] = []
    for m in sorted(matches, key=lambda m: (len(index.words[m[0]]) < LONG, -m[1], -m[2], m[0], m[3])):
        if all(m[4] <= k[3] or m[3] >= k[4] for k in kept):
            kept.append(m)
    if not kept:
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    return [(x, c, n, spans[a][0], spans[b - 1][1]) for x, c, n, a, b in sorted(kept, key=lambda m: m[3])]


def find_licenses(docs: DataFrame, templates: dict[str, str] = LICENSES, coverage: float = COVERAGE) -> DataFrame:
    """One row per match: doc_id, license, coverage, n_words, start, stop, passage."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        kind = pa.schema(
            [("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_words", pa.int64()),
             ("start", pa.int64()), ("stop", pa.int64()), ("passage", pa.string())]
        )
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                whole = text.as_py()
                for name, share, n, start, stop in scan(index, whole, coverage):
                    out.append((doc_id.as_py(), name, share, n, start, stop, whole[start:stop]))
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in out], kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        scanned,
        "doc_id long, license string, coverage double, n_words long, start long, stop long, passage string",
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(documents(spark, sf_dir))
