"""License notices in documents.

Templates and documents become shingles of five words. A template with S of them is looked for in windows
of 2c shingles that begin every c, where c is the power of two from S on; so each occurrence lies whole in
one window, and the two have a Jaccard similarity of 0.2 or more. MinHash with 64 bands of one row
retrieves a template from such a window with a probability over 1 - 0.8^64, or 0.999999. Templates of one
or two shingles must be there whole; their windows are their own size and one band finds them for sure.
Then the shingles of the window decide: a match contains 0.8 of the template's or more.

Row-local, without a shuffle: the templates are a parameter, every task has them. Null texts are empty and
match nothing; a template without five words, and a text of fewer words than a template, match nothing.
Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import words as W

BANDS = 64
CONTAINMENT = 0.8
WHOLE = 2

#: Notices by which texts name their license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version",
    "LGPL": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version",
    "AGPL": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

_FACTOR = (W.mix(np.arange(1, BANDS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _min_hash(shingle: np.ndarray, band: int) -> np.ndarray:
    """The band's order of shingles; they are fingerprints already, so a product spreads them enough."""
    low = (shingle >> np.uint64(32)).astype(np.uint32) if shingle.dtype == np.uint64 else shingle
    value = low * _FACTOR[band]
    return value ^ (value >> np.uint32(15))


@dataclass
class Index:
    """Templates by the width of their windows: names, shingles, and a band's minima with their templates."""

    names: list[str]
    shingles: list[np.ndarray]
    widths: dict[int, list[int]]
    bands: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def index(templates: dict[str, str]) -> Index:
    names, kept = [], []
    for name, text in templates.items():
        values, counts = W.words(pa.array([text]))
        if len(values) >= W.SHINGLE_WORDS:
            names.append(name)
            kept.append(np.unique(W.windows(values, counts, W.SHINGLE_WORDS)[0]))
    widths: dict[int, list[int]] = {}
    for i, shingle in enumerate(kept):
        widths.setdefault(1 << (len(shingle) - 1).bit_length(), []).append(i)
    bands = {}
    for width, members in widths.items():
        for band in range(1 if width <= WHOLE else BANDS):
            minima = np.array([_min_hash(kept[i], band).min() for i in members], np.uint32)
            order = np.argsort(minima)
            coarse = np.zeros(1 << 16, bool)
            coarse[minima >> np.uint32(16)] = True
            bands[width, band] = (coarse, minima[order], np.array(members)[order])
    return Index(names, kept, widths, bands)


def candidates(own: Index, shingle: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per band and width of windows: width, first shingle of a window, shingle after it, and a template."""
    n = len(shingle)
    place = np.arange(n) - np.searchsorted(text, text)
    short = (shingle >> np.uint64(32)).astype(np.uint32)
    # where blocks of a width begin, counted in blocks of the width before, and where a text has another one
    blocks, at, width = [], np.arange(n), 1
    while width < max(own.widths, default=0):
        width *= 2
        begin = np.flatnonzero(place[at] % width == 0)
        at = at[begin]
        more = np.flatnonzero(text[at[1:]] == text[at[:-1]])
        to = np.append(at[1:], n)
        to[more] = to[more + 1]
        blocks.append((width, begin, at, more, to))
    for band in range(BANDS):
        value = _min_hash(short, band)
        least = value
        for width in (w for w in own.widths if w <= WHOLE and (w, band) in own.bands):
            first = np.arange(n - width + 1)
            first = first[text[first] == text[first + width - 1]]
            low = value[first] if width == 1 else np.minimum(value[first], value[first + 1])
            yield from _hits(own, width, band, low, first, first + width)
        for width, begin, at, more, to in blocks:
            least = np.minimum.reduceat(least, begin)
            if width > WHOLE and (width, band) in own.bands:
                low = least.copy()
                low[more] = np.minimum(low[more], least[more + 1])
                yield from _hits(own, width, band, low, at, to)


def _hits(own: Index, width: int, band: int, low, first, to):
    coarse, minima, members = own.bands[width, band]
    hit = np.flatnonzero(coarse[low >> np.uint32(16)])
    a, b = np.searchsorted(minima, low[hit]), np.searchsorted(minima, low[hit], side="right")
    for extra in range(int((b - a).max(initial=0))):
        there = a + extra < b
        yield width, first[hit[there]], to[hit[there]], members[a[there] + extra]


def _matches(templates: dict[str, str], containment: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index(templates)
        for batch in batches:
            for part in W.pieces(batch, "text"):
                values, counts = W.words(part["text"])
                shingle, at, text = W.windows(values, counts, W.SHINGLE_WORDS)
                best: dict[tuple[int, int], tuple[float, int]] = {}
                seen = set()
                if len(shingle):
                    for _, first, to, template in candidates(own, shingle, text):
                        seen.update(zip(first.tolist(), to.tolist(), template.tolist(), strict=True))
                for first, to, template in sorted(seen):
                    wanted = own.shingles[template]
                    found = np.isin(shingle[first:to], wanted)
                    share = len(np.unique(shingle[first:to][found])) / len(wanted)
                    key = (int(text[first]), template)
                    if share >= containment - 1e-9 and share > best.get(key, (0.0, 0))[0]:
                        begin = first + int(np.argmax(found))
                        best[key] = (share, int(at[begin] - counts[text[first]]))
                rows = sorted(best)
                yield pa.record_batch(
                    {
                        "id": part["id"].take(pa.array([r[0] for r in rows], pa.int64())),
                        "license": pa.array([own.names[r[1]] for r in rows], pa.string()),
                        "containment": pa.array([best[r][0] for r in rows], pa.float64()),
                        "word": pa.array([best[r][1] for r in rows], pa.int64()),
                    }
                )

    return run


def scan(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    containment: float = CONTAINMENT,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """A row for each document and template in it: ``key``, license, containment, and the word it begins at.

    Of several places the one with the largest containment counts, the first of equal ones.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_matches(templates, containment), f"id {kind}, license string, containment double, word long")
    return found.withColumnRenamed("id", key)
