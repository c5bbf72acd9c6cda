"""Licence notices in documents: MinHash retrieval, then exact containment.

Documents and templates are words (lower-cased, ASCII signs dropped). Windows of WINDOW word pairs, one every
STRIDE pairs, get BANDS MinHash values of one row each. A template's windows start at every pair, so a notice
that stands in a document whole shares a window with it: all pairs of a long notice, or the whole of a short
one (up to WINDOW - STRIDE + 1 pairs lie inside one window). The Jaccard similarity of those windows is at
least 4 / WINDOW = 1/3 for the shortest template of five words, so the chance that no band agrees is at most
(2/3) ** 32 < 3e-6. Retrieved templates are then verified exactly: the share of the template's shingles of
SHINGLE words that the document holds must be at least CONTAINMENT.

The templates are a fixed list of bounded size; they travel with the code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeworks.llm.common import pick, slices
from gaugeworks.llm.words import WordHashes, running_hashes

WINDOW, STRIDE, BANDS, SHINGLE, CONTAINMENT, FILTER_BITS = 12, 4, 32, 5, 0.8, 20

# Notices as their licences or stewards word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_rng = np.random.default_rng(11)
FACTORS = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def _slots(pairs: np.ndarray) -> np.ndarray:
    """BANDS x pairs hash values."""
    return ((pairs[None, :] * FACTORS[:, None] + OFFSETS[:, None]) >> np.uint64(32)).astype(np.uint32)


def document_windows(pairs: np.ndarray) -> np.ndarray:
    """BANDS x windows: the least value of each window, from blocks of STRIDE pairs; the last may be short."""
    slots = _slots(pairs)
    block = np.minimum.reduceat(slots, np.arange(0, slots.shape[1], STRIDE), axis=1)
    wide = WINDOW // STRIDE
    if block.shape[1] <= wide:
        return block.min(1, keepdims=True)
    n = block.shape[1] - wide + 1
    out = block[:, :n]
    for k in range(1, wide):
        out = np.minimum(out, block[:, k : k + n])
    return out


def template_windows(pairs: np.ndarray) -> np.ndarray:
    slots = _slots(pairs)
    n = max(1, slots.shape[1] - WINDOW + 1)
    return np.stack([slots[:, k : k + WINDOW].min(1) for k in range(n)], axis=1)


class Templates:
    def __init__(self, texts: dict[str, str]):
        words = WordHashes()
        self.names = list(texts)
        hashed = [words.text(t) for t in texts.values()]
        short = [n for n, w in zip(self.names, hashed, strict=True) if len(w) < SHINGLE]
        if short:
            raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
        self.shingles = [np.unique(running_hashes(w, SHINGLE)) for w in hashed]
        self.maybe = np.zeros((BANDS, 1 << FILTER_BITS), bool)
        self.bands: dict[tuple[int, int], set[int]] = {}
        for t, w in enumerate(hashed):
            for k, row in enumerate(template_windows(running_hashes(w, 2))):
                self.maybe[k, row >> (32 - FILTER_BITS)] = True
                for value in row.tolist():
                    self.bands.setdefault((k, value), set()).add(t)

    def retrieved(self, words: np.ndarray) -> set[int]:
        """Templates that share a band value with a window of the document."""
        pairs = running_hashes(words, 2)
        if not len(pairs):
            return set()
        windows = document_windows(pairs)
        k, at = np.nonzero(self.maybe[np.arange(BANDS)[:, None], windows >> (32 - FILTER_BITS)])
        return set().union(*(self.bands.get(key, ()) for key in zip(k.tolist(), windows[k, at].tolist(), strict=True)))

    def found(self, words: np.ndarray, containment: float) -> list[tuple[str, float, int]]:
        """(template, share of its shingles, first word) of each verified template."""
        out = []
        candidates = sorted(self.retrieved(words))
        if candidates:
            runs = running_hashes(words, SHINGLE)
            for t in candidates:
                held = np.isin(runs, self.shingles[t])
                share = len(np.unique(runs[held])) / len(self.shingles[t])
                if share >= containment:
                    out.append((self.names[t], share, int(held.argmax())))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word): a row for each document and notice that its whole text holds.

    Documents without a notice, and null or empty texts, have no row. Repeated rows are reported each. An empty
    table gives no rows.
    """
    texts = TEMPLATES if templates is None else templates

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = Templates(texts), WordHashes()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(k, *hit) for k, text in enumerate(part.column("text").to_pylist()) for hit in known.found(words.text(text), containment)]
                if rows:
                    at, names, shares, firsts = zip(*rows, strict=True)
                    columns = [part.column("doc_id").take(pa.array(at)), pa.array(names), pa.array(shares, pa.float64()), pa.array(firsts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "containment", "first_word"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, license string, containment double, first_word long")
