"""License scan: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, hash_words, text_slices

# Widely used notices. Headers are as their owners publish them, one-liners as they are common in files; the
# whole texts stand in license_texts.
TEMPLATES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 2."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, Version 2.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
}
GRAM = 3
WINDOW = 3
BAND = 8
LEAST = 0.8
LONG = 200
SIEVE = 1 << 20
WORDS = re.compile(r"[^\W_]+")
#: What names a license. A notice that holds such a phrase is found only with it, whatever else may differ.
NAMING = {
    "MIT": ["mit"],
    "Apache-2.0": ["apache license", "2 0"],
    "GPL-3.0": ["gnu general public", "3"],
    "GPL-2.0": ["gnu general public", "2"],
    "AGPL-3.0": ["affero", "3"],
    "LGPL-3.0": ["lesser", "3"],
    "LGPL-2.1": ["lesser", "2 1"],
    "BSD": ["bsd"],
    "MPL-2.0": ["mozilla", "2 0"],
    "CC-BY-4.0": ["commons attribution 4 0"],
    "CC-BY-SA-4.0": ["attribution sharealike 4 0"],
    "CC-BY-NC-4.0": ["attribution noncommercial 4 0", "cc by nc 4 0"],
    "CC-BY-ND-4.0": ["attribution noderivatives 4 0"],
    "CC-BY-NC-SA-4.0": ["attribution noncommercial sharealike 4 0"],
    "CC-BY-NC-ND-4.0": ["attribution noncommercial noderivatives 4 0"],
}
#: A whole GPL-3.0 stands word for word in most of the AGPL-3.0, but for this title of a section.
FOREIGN = {"GPL-3.0": "Remote Network Interaction"}


def whole_texts() -> dict[str, list[str]]:
    """Whole licenses by name; the part of a file's name after a space tells wordings of one license apart."""
    out = defaultdict(list)
    for f in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        if f.name.endswith(".txt"):
            out[f.name.removesuffix(".txt").split(" ")[0]].append(f.read_text(encoding="utf-8"))
    return out


def all_templates() -> dict[str, list[str]]:
    """Notices and whole licenses."""
    whole = whole_texts()
    return {name: TEMPLATES.get(name, []) + whole.get(name, []) for name in [*TEMPLATES, *(n for n in whole if n not in TEMPLATES)]}


def band_of(n: int) -> int:
    """Width of the band on either side for a template of n words: what is added or left out adds up along a long one."""
    return max(BAND, n // 20)


def winnow(h: np.ndarray, window: int = WINDOW) -> set[int]:
    """Places of the window minima (the rightmost of equals); a shorter list is one window."""
    w = min(window, len(h))
    return {i + w - 1 - int(np.argmin(h[i : i + w][::-1])) for i in range(len(h) - w + 1)} if w else set()


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Banded alignment of a template with a stretch of text: (matched words, first and last matched place or -1).

    Cell (i, d) aligns i template words with the text up to place i + shift + d - band; leaving out a word on either
    side is free, so the count is the longest common subsequence inside the band. Of equal counts the one that begins last is
    kept, and at the end the shortest stretch next to the shift, so that a match does not reach into its neighbour.
    """
    width, big = 2 * band + 1, 1 << 32
    best = np.full(width, -1, np.int64)  # matched * big + first place; -1 without a match
    tail = np.full(width, -1, np.int64)
    for i, w in enumerate(template):
        at = np.arange(width) + i + shift - band
        ok = (at >= 0) & (at < len(text))
        hit = np.zeros(width, bool)
        hit[ok] = text[at[ok]] == w
        # skip the template word: the same text place was one cell further in the row before
        up, up_tail = np.append(best[1:], -1), np.append(tail[1:], -1)
        with_hit = np.where(best >= 0, best + big, big + at)
        take = hit & (with_hit >= up)
        best, tail = np.where(take, with_hit, up), np.where(take, at, up_tail)
        top = np.maximum.accumulate(best)  # skip text words
        tail, best = tail[np.maximum.accumulate(np.where(best == top, np.arange(width), 0))], top
    if best.max() < 0:
        return 0, -1, -1
    matched, head = best // big, best % big
    ends = np.flatnonzero(matched == matched.max())
    d = ends[np.lexsort((np.abs(head[ends] - shift), tail[ends] - head[ends]))[0]]
    return int(matched[d]), int(head[d]), int(tail[d])


def most_matched(template: np.ndarray, text: np.ndarray, shift: int, band: int, block: int = 64) -> int:
    """An upper bound of align()'s count: for each block of the template the words that it has in common with its part of the band."""
    _, code = np.unique(np.concatenate([template, text]), return_inverse=True)
    a, b, m = code[: len(template)], code[len(template) :], int(code.max()) + 1
    return sum(
        int(np.minimum(np.bincount(a[k : k + block], minlength=m), np.bincount(b[max(0, k + shift - band) : max(0, k + shift + block + band)], minlength=m)).sum()) for k in range(0, len(a), block)
    )


def coded(text: str) -> np.ndarray:
    return hash_words([w.lower() for w in WORDS.findall(text)])


def holds(part: np.ndarray, phrase: str) -> bool:
    """Whether the words of a phrase stand in a row."""
    p = coded(phrase)
    return len(part) >= len(p) and bool(np.logical_and.reduce([part[k : len(part) - len(p) + 1 + k] == w for k, w in enumerate(p)]).any())


class Index:
    """Inverted index from fingerprints to (template, place), and the templates' words."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        self.names, self.words, self.naming, self.at = [], [], [], defaultdict(list)
        for name, texts in templates.items():
            for t in texts:
                h = coded(t)
                grams = gram_hashes(h, GRAM)
                for i in sorted(winnow(grams)):
                    self.at[int(grams[i])].append((len(self.names), i))
                self.names.append(name)
                self.words.append(h)
                self.naming.append([p for p in NAMING.get(name, ()) if len(h) <= LONG and holds(h, p)])
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[np.array([g % SIEVE for g in self.at], np.int64)] = True
        self.least_words = {g: min(len(self.words[t]) for t, _ in at) for g, at in self.at.items()}

    def candidates(self, texts: pa.Array, least: float = LEAST) -> np.ndarray:
        """Places of the texts that hold a fingerprint of a template that they are long enough for, by all their n-grams in columns."""
        plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN]+", " ")
        lists = pc.utf8_split_whitespace(plain)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        words = coded.dictionary.to_pylist()
        if not words:
            return np.empty(0, np.int64)
        h = hash_words(words)[coded.indices.to_numpy(zero_copy_only=False)]
        grams = gram_hashes(h, GRAM)
        hit = np.flatnonzero(self.sieve[(grams % np.uint64(SIEVE)).astype(np.int64)])
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        owner = np.searchsorted(np.cumsum(sizes), hit, side="right")
        needed = np.array([self.least_words.get(g, np.inf) for g in grams[hit].tolist()], float)
        return np.unique(owner[sizes[owner] >= least * needed])

    def foreign(self, t: int, part: np.ndarray) -> bool:
        """Whether a stretch lacks a phrase that names this template's license, or holds words that tell another from it."""
        name = self.names[t]
        return not all(holds(part, p) for p in self.naming[t]) or name in FOREIGN and holds(part, FOREIGN[name])

    def scan(self, text: str, least: float = LEAST) -> list[tuple[str, int, int, int, float]]:
        """Matches (license, start, end, matched words, coverage) in a text; of overlapping ones that with the most matched words, then coverage."""
        spans = [m.span() for m in WORDS.finditer(text)]
        h = hash_words([text[a:b].lower() for a, b in spans])
        hits = Counter((t, i - j) for i, g in enumerate(gram_hashes(h, GRAM).tolist()) for t, j in self.at.get(g, ()))
        tries: dict[tuple[int, int], int] = {}
        first = None
        for (t, shift), c in sorted(hits.items()):
            if not first or first[0] != t or shift - first[1] > band_of(len(self.words[t])) // 2:
                first = (t, shift)  # later ones are within the band of this alignment
            tries[first] = tries.get(first, 0) + c
        found = []
        done: dict[int, list[int]] = defaultdict(list)  # shifts of the whole texts found
        for (t, shift), _ in sorted(tries.items(), key=lambda x: (-x[1], x[0])):
            words = self.words[t]
            n, band = len(words), band_of(len(words))
            if n > LONG and any(abs(shift - x) < n // 2 for x in done[t]):
                continue  # the same copy again, shifted
            lo = max(0, shift - band)
            part = h[lo : shift + n + band + 1]
            if len(part) < least * n or n > LONG and most_matched(words, part, shift - lo, band) < least * n:
                continue  # can't match that many words
            matched, a, b = align(words, part, shift - lo, band)
            if matched >= least * n and not self.foreign(t, h[lo + a : lo + b + 1]):
                done[t].append(shift)
                found.append((-matched, -matched / n, spans[lo + a][0], spans[lo + b][1], self.names[t]))
        out: list[tuple[str, int, int, int, float]] = []
        for m, c, a, b, name in sorted(found):
            if all(b <= x[1] or a >= x[2] for x in out):
                out.append((name, a, b, -m, -c))
        return sorted(out, key=lambda x: x[1:])


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, license, start, end, words, coverage``: each stretch of a text that holds a license template.

    A map over whole texts, without shuffle; the index of the templates (notices and whole licenses) is small and fixed. Every n-gram of a text is looked
    up, so that a template of which GRAM + WINDOW - 1 words stand in a row is found; alignment allows words to be added,
    left out or changed, down to ``least`` of the template. Offsets count code points. Null and empty texts hold none; equal
    rows give equal results.
    """
    found = docs.sparkSession.sparkContext.broadcast(templates or all_templates())
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(found.value)
        for whole in batches:
            for b in text_slices(whole, "t"):
                some = b.take(pa.array(index.candidates(b.column("t"), least)))
                hits = [(d, *x) for d, t in zip(some.column("doc_id").to_pylist(), some.column("t").to_pylist(), strict=True) for x in index.scan(t, least)]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "license", "start", "end", "words", "coverage"])

    return rows.mapInArrow(run, "doc_id long, license string, start int, end int, words int, coverage double")
