"""Operator 2, license scans: winnowed template fingerprints, an inverted index and banded alignment.

Templates are notices (NOTICES) and the whole licence texts in the folder `licenses`. Their GRAM-word grams are winnowed (window
WINDOW); an inverted index maps the hashes to (template, place). One scan looks all grams of every text up in the index. Hits
that continue each other are runs of equal words; runs that follow one another in both text and template, at most GAP text words
apart, are chained, so that words put in or left out between them don't part them. A chain whose runs hold SUPPORT of the
template is a candidate: a local alignment (match +2, other word -1, skipped word -1) in the band of the chain's diagonals and BAND
beyond gives the words that agree, in order. Reported is what covers at least COVERAGE of the template, the fullest first; its words
are masked, and candidates that lost words are aligned again, so that notices in a row are found one by one and no place twice.

Defined results: (doc_id, template, coverage, matched_words, start_word, end_word, start_byte, end_byte), one row per template and place;
bytes count in the UTF-8 text. Null or empty texts match nothing; a null doc_id is reported as null; repeated rows are reported each;
templates of fewer than GRAM words are refused; where templates contain each other, all of them are reported.
"""

from __future__ import annotations

import heapq
import pathlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import words as W
from .common import documents, table

GRAM = 3
WINDOW = 2
BAND = 8
COVERAGE = 0.6
GAP = 100
#: Share of a template's words that a chain's runs must hold to be aligned. Of 60 % equal words at random places, 39 % stand in runs of GRAM.
SUPPORT = 0.15
_MASKED = np.uint64(0)
_LOW = (1 << 20) - 1

NOTICES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-3-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
}


#: Name to text: the notices and the whole licences.
TEMPLATES = NOTICES | {p.stem.lower() + "-text": p.read_text(encoding="utf-8") for p in sorted((pathlib.Path(__file__).parent / "licenses").glob("*.txt"))}


class TemplateIndex:
    """Inverted index from fingerprint to (template, place)."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.h: list[np.ndarray] = []
        hashes, number, place = [], [], []
        for w in W.split(pa.array([templates[n] for n in self.names], pa.large_string()), 1 << 40):
            for d in range(w.docs):
                if w.at[d + 1] - w.at[d] < GRAM:
                    raise ValueError(f"template {self.names[d]} has fewer than {GRAM} words")
                self.h.append(w.h[w.at[d] : w.at[d + 1]])
            p, h = W.winnow(w, GRAM, WINDOW)
            d = np.searchsorted(w.at, p, "right") - 1
            hashes, number, place = h, d, p - w.at[d]
        o = np.argsort(hashes, kind="stable") if len(hashes) else np.zeros(0, np.int64)
        self.key, self.number, self.place = (np.asarray(x)[o] for x in (hashes, number, place)) if len(o) else (np.zeros(0, np.uint64), o, o)
        self.low = np.zeros(_LOW + 1, bool)
        self.low[(self.key & np.uint64(_LOW)).astype(np.int64)] = True

    def hits(self, w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, template, place in it) for every gram of the slice that is a fingerprint."""
        g, ok = W.gram_hash(w, GRAM)
        if not len(g) or not len(self.key):
            z = np.zeros(0, np.int64)
            return z, z, z
        at = np.flatnonzero(self.low[(g & np.uint64(_LOW)).astype(np.int64)] & ok)
        a, e = np.searchsorted(self.key, g[at], "left"), np.searchsorted(self.key, g[at], "right")
        n = e - a
        idx = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else a, n) + np.arange(n.sum())
        return np.repeat(at, n), self.number[idx], self.place[idx]


def align(template: np.ndarray, text: np.ndarray, lo: int, hi: int) -> tuple[int, int, int, int]:
    """(score, matched words, first, end in the text) of the best local alignment whose diagonals (text place - template place)
    lie in lo..hi."""
    k = np.arange(hi - lo + 1)
    score, matched, first = (np.zeros(len(k) + 1, np.int64) for _ in range(3))
    best = (0, 0, 0, 0)
    for i in range(max(0, -hi), min(len(template), len(text) - lo)):
        at = i + lo + k
        inside = (at >= 0) & (at < len(text))
        equal = inside & (text[np.clip(at, 0, len(text) - 1)] == template[i])
        diag = score[:-1] + np.where(equal, 2, -1)  # one word on in both
        up = score[1:] - 1  # a template word without partner
        from_diag = diag >= up
        m, f = np.where(from_diag, matched[:-1] + equal, matched[1:]), np.where(from_diag, first[:-1], first[1:])
        fresh = from_diag & equal & (score[:-1] <= 0)
        m[fresh], f[fresh] = 1, at[fresh]
        new = np.where(inside, np.maximum(np.maximum(diag, up), 0), 0)
        lead = np.maximum.accumulate(new + k)  # text words without partner
        src = np.maximum.accumulate(np.where(new + k == lead, k, 0))
        new = np.where(inside, np.maximum(lead - k, 0), 0)
        score[:-1], matched[:-1], first[:-1] = new, m[src], f[src]
        j = int(np.argmax(new))
        if new[j] > best[0]:
            best = (int(new[j]), int(matched[j]), int(first[j]), int(at[j]) + 1)
    return best


def chains(x: list[int], y: list[int], size: list[int]) -> list[tuple[int, int, int]]:
    """(least diagonal, greatest diagonal, words) of chains of runs of equal words, the heaviest first; every run is in one of them. The runs
    begin at text places x (ascending) and template places y."""
    n = len(x)
    weight, before = list(size), [-1] * n
    low = 0
    for i in range(n):
        while x[i] - x[low] > GAP + size[low]:
            low += 1
        for j in range(low, i):
            gap = x[i] - x[j] - size[j]
            if gap <= GAP and y[i] > y[j] and x[i] > x[j]:
                over = max(0, -gap, y[j] + size[j] - y[i])
                w = weight[j] + size[i] - over - abs(x[i] - y[i] - x[j] + y[j]) / 2
                if w > weight[i]:
                    weight[i], before[i] = w, j
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-weight[i], i)):
        lo = hi = x[i] - y[i]
        words, j = 0, i
        while j >= 0 and not used[j]:
            used[j] = True
            lo, hi, words = min(lo, x[j] - y[j]), max(hi, x[j] - y[j]), words + size[j]
            j = before[j]
        if words:
            out.append((lo, hi, words))
    return out


def places(template: np.ndarray, text: np.ndarray, bands: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(matched words, first, end) of all places of the template in bands of diagonals, the fullest first; places don't overlap."""
    text = text.copy()
    heap, out = [], []

    def look(lo: int, hi: int) -> None:
        score, n, a, e = align(template, text, lo, hi)
        if n >= COVERAGE * len(template):
            heapq.heappush(heap, (-n, -score, a, e, lo, hi))

    for lo, hi in bands:
        look(lo, hi)
    while heap:
        n, _, a, e, lo, hi = heapq.heappop(heap)
        if not (text[a:e] == _MASKED).any():
            out.append((-n, a, e))
            text[a:e] = _MASKED
        look(lo, hi)
    return out


def scan_words(index: TemplateIndex, w: W.Words) -> list[tuple[int, int, float, int, int, int]]:
    """(document, template, coverage, matched words, first word, end word) of a slice."""
    at, number, place = index.hits(w)
    if not len(at):
        return []
    doc = np.searchsorted(w.at, at, "right") - 1
    x = at - w.at[doc]
    o = np.lexsort((place, x - place, number, doc))
    doc, number, x, place = doc[o], number[o], x[o], place[o]
    new = np.ones(len(o), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1]) | (x[1:] - place[1:] != x[:-1] - place[:-1]) | (place[1:] - place[:-1] > GRAM)
    a = np.flatnonzero(new)  # the runs of equal words
    z = np.append(a[1:], len(o)) - 1
    doc, number, x, y, size = doc[a], number[a], x[a], place[a], place[z] - place[a] + GRAM
    own = np.ones(len(a), bool)
    own[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
    g = np.flatnonzero(own)
    enough = np.add.reduceat(size, g) >= SUPPORT * np.array([len(h) for h in index.h])[number[g]]
    out = []
    for i, j in zip(g[enough].tolist(), np.append(g[1:], len(a))[enough].tolist()):
        d, t = int(doc[i]), int(number[i])
        by = i + np.argsort(x[i:j], kind="stable")
        found = chains(x[by].tolist(), y[by].tolist(), size[by].tolist())
        bands = sorted({(lo - BAND, hi + BAND) for lo, hi, n in found if n >= SUPPORT * len(index.h[t])})
        if bands:
            out += [(d, t, n / len(index.h[t]), n, b, e) for n, b, e in places(index.h[t], w.h[w.at[d] : w.at[d + 1]], bands)]
    return sorted(out)


def _scan(index: TemplateIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in W.split(b["text"]):
                rows = scan_words(index, w)
                if not rows:
                    continue
                d, t, c, n, a, e = (np.array(x) for x in zip(*rows))
                begin = w.start[w.at[d] + a] - w.byte_at[d]
                end = w.end[w.at[d] + e - 1] - w.byte_at[d]
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].take(pa.array(w.first + d)), pa.array([index.names[x] for x in t]), pa.array(c), *(pa.array(x.astype(np.int32)) for x in (n, a, e, begin, end))],
                    ["doc_id", "template", "coverage", "matched_words", "start_word", "end_word", "start_byte", "end_byte"],
                )

    return run


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    return documents(docs, "doc_id", "text").mapInArrow(_scan(TemplateIndex(templates)), "doc_id bigint, template string, coverage double, matched_words int, start_word int, end_word int, start_byte int, end_byte int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
