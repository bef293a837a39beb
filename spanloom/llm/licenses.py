"""Licence notices in texts: winnowed fingerprints, an inverted index, and banded alignment.

Texts and templates are compared as lower-case runs of letters and digits. Of the hashes of all
``GRAM`` consecutive words, the smallest of every ``WINDOW`` neighbours is a fingerprint, so a shared
run of GRAM + WINDOW - 1 words shares one. Fingerprints of a text are looked up in the templates'
inverted index; templates too short for that guarantee are looked up by all their hashes. Hits of one
template on near diagonals are one candidate, and a local alignment within a band around their
diagonal gives the matched words, their share of the template (coverage) and the span in the text.

The templates are a fixed list, so the index goes to the workers with the function. A text's hits are
handled one after the other; nothing is shuffled.

Nulls: a null or empty text has no matches; a null id is kept. Of matches that overlap, also of
several templates, the best is reported (ties: the template listed first). Repeated rows are reported
once each. Very long texts are read whole; other columns, whatever their names, play no part. Empty
tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column_or_null, parts_by_bytes, per_batch, texts_of, window_hashes, word_hashes

GRAM = 3
WINDOW = 2
BAND = 6
LEAST_COVERAGE = 0.8
BATCH_BYTES = 1 << 20

# Wording of public licence notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("All-rights-reserved", "All rights reserved"),
)

_PLAIN = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in bytes(range(256)).lower())


def plain_words(text: bytes) -> bytes:
    """Text with capital ASCII letters lowered and punctuation blanked, byte for byte."""
    return text.translate(_PLAIN)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash of every ``window`` neighbours (the last of equal ones)."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


@dataclass
class Index:
    """Templates as word hashes, and the inverted index from hash to (template, position)."""

    words: list[np.ndarray]
    hashes: np.ndarray
    template: np.ndarray
    position: np.ndarray
    always: np.ndarray  # hashes that are looked up at every place


@cache
def index_of(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Index:
    words, hashes, template, position, always = [], [], [], [], []
    for n, (_, text) in enumerate(templates):
        own = word_hashes([plain_words(text.encode())], 1)[0][0]
        words.append(own)
        grams = window_hashes(own, GRAM, 0)
        if len(own) < GRAM:
            raise ValueError(f"template {n} is shorter than {GRAM} words")
        # All of a template's hashes are listed: which of them a text's winnowing keeps at the
        # borders of a notice depends on the words around it.
        hashes.append(grams)
        template.append(np.full(len(grams), n))
        position.append(np.arange(len(grams)))
        if len(own) < 2 * (GRAM + WINDOW - 1):
            always.append(grams)
    joined = np.concatenate(hashes)
    order = np.argsort(joined, kind="stable")
    return Index(
        words, joined[order], np.concatenate(template)[order], np.concatenate(position)[order],
        np.unique(np.concatenate(always)) if always else np.zeros(0, np.uint64),
    )


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(values), bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Most matched words of a local alignment near a diagonal, and its first and last word in the text.

    A match counts 2, an unmatched word on either side costs 1; among equal scores the earliest end.
    """
    width = 2 * band + 1
    score = np.zeros((len(template) + 1, width), np.int64)
    matched, start = np.zeros_like(score), np.zeros_like(score)
    best = (0, 0, 0, -1)
    for i in range(1, len(template) + 1):
        for d in range(width):
            j = i - 1 + diagonal - band + d  # text word aligned with template word i - 1
            if not 0 <= j < len(text):
                continue
            options = [(0, 0, j + 1)]
            same = template[i - 1] == text[j]
            if same:
                before = score[i - 1, d], matched[i - 1, d], start[i - 1, d]
                options.append((before[0] + 2, before[1] + 1, before[2] if before[0] else j))
            else:
                options.append((score[i - 1, d] - 2, matched[i - 1, d], start[i - 1, d]))
            if d + 1 < width:
                options.append((score[i - 1, d + 1] - 1, matched[i - 1, d + 1], start[i - 1, d + 1]))
            if d > 0:
                options.append((score[i, d - 1] - 1, matched[i, d - 1], start[i, d - 1]))
            top = max(options, key=lambda o: (o[0], o[1]))
            if top[0] <= 0:
                top = (0, 0, j + 1)
            score[i, d], matched[i, d], start[i, d] = top
            if same and top[0] > best[0]:
                best = (top[0], top[1], top[2], j)
    return int(best[1]), int(best[2]), int(best[3])


def matches_in(words: np.ndarray, index: Index, least: float = LEAST_COVERAGE, band: int = BAND) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, last word) of a text's word hashes."""
    grams = window_hashes(words, GRAM, 0)
    if not len(grams):
        return []
    kept = np.zeros(len(grams), bool)
    kept[winnow(grams)] = True
    kept &= _among(grams, index.hashes)
    kept |= _among(grams, index.always)
    hits: dict[int, list[tuple[int, int]]] = {}
    for at in np.flatnonzero(kept).tolist():
        a, b = np.searchsorted(index.hashes, [grams[at], grams[at]])[0], np.searchsorted(index.hashes, grams[at], "right")
        for k in range(a, b):
            hits.setdefault(int(index.template[k]), []).append((at - int(index.position[k]), at))
    found = []
    for n, own in sorted(hits.items()):
        template, taken_to, failed = index.words[n], -1, None
        for diagonal, at in own:  # in the order of the text
            if at <= taken_to or (failed is not None and abs(diagonal - failed) <= band // 2):
                continue
            low, high = max(0, diagonal - band, taken_to + 1), min(len(words), diagonal + len(template) + band)
            matched, first, last = align(template, words[low:high], diagonal - low, band)
            failed = diagonal
            if matched >= least * len(template):
                found.append((n, matched, low + first, low + last))
                taken_to, failed = low + last, None
    return resolved(found, index)


def resolved(found: list[tuple[int, int, int, int]], index: Index) -> list[tuple[int, int, int, int]]:
    """Of matches that overlap the best: most matched words less unmatched ones on either side."""

    def rank(match: tuple[int, int, int, int]) -> tuple[int, int]:
        n, matched, first, last = match
        return 3 * matched - (last - first + 1) - len(index.words[n]), -n

    kept: list[tuple[int, int, int, int]] = []
    for match in sorted(found, key=rank, reverse=True):
        if all(match[3] < k[2] or match[2] > k[3] for k in kept):
            kept.append(match)
    return sorted(kept, key=lambda m: m[2])


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST_COVERAGE, band: int = BAND) -> DataFrame:
    """doc_id, license, template, n_matched, coverage, start_char, end_char: one row per match.

    Characters are counted from 0 in the text; the end is exclusive.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, rows = index_of(templates), []
        ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
        for begin, end in parts_by_bytes(map(len, texts), BATCH_BYTES):
            plain = [plain_words(t) for t in texts[begin:end]]
            (hashes,), counts = word_hashes(plain, 1)
            grams = window_hashes(hashes, GRAM, 0)
            ends = np.cumsum(counts)
            # Only texts with a hash of the index are looked at one by one.
            hit = np.flatnonzero(_among(grams, index.hashes))
            for i in np.unique(np.searchsorted(ends, hit, side="right")).tolist():
                found = matches_in(hashes[ends[i] - counts[i] : ends[i]], index, least, band)
                if not found:
                    continue
                text, source = texts[begin + i], plain[i]
                buffer = np.frombuffer(source, np.uint8)
                edge = np.diff(np.isin(buffer, [9, 10, 11, 12, 13, 32], invert=True).astype(np.int8), prepend=0, append=0)
                first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                for n, matched, a, b in found:
                    span = [len(text[: int(x)].decode("utf-8", "replace")) for x in (first[a], last[b])]
                    rows.append((ids[begin + i], templates[n][0], n, matched, matched / len(index.words[n]), *span))
        columns = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        names = ["doc_id", "license", "template", "n_matched", "coverage", "start_char", "end_char"]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    narrow = docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"))
    return narrow.mapInArrow(
        per_batch(each), "doc_id long, license string, template long, n_matched long, coverage double, start_char long, end_char long"
    )
