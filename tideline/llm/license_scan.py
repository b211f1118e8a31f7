"""License scans by patience alignment.

A template's words are aligned with a text in order: words that stand exactly once
in both are anchors, the longest increasing run of them is kept, matches grow to
both sides of each anchor, and the gaps between are aligned the same way; a small gap
without an anchor by its longest common subsequence.  The coverage is the share of the template's words that are aligned.

A text's words that the template doesn't have match nothing and are left out first.
A license may stand more than once: the template's word that is rarest in the text
divides it, so that the word is unique in each piece (from the place before to the
place after), and each piece is aligned, at first near the word only.  Where one word finds
nothing the next rarest is tried, of all the telling words (those not in ``PLAIN``).
What is found is taken out, and the rest is searched again.  A license with all its words
takes at most ``SPREAD`` times the template's length, foreign words included; up to a
tenth of its words (or two) that stand off by half that length are strays and don't count.

No alignment covers more than the words that text and template share, so where these
are too few none is made.  The templates are a fixed small list; a text is scanned
whole, in one pass.

Defined cases: a null or wordless text has no license; where several templates fit
one place the one with most aligned words counts, then the better coverage, then the
first in the list; a document's license is the one with most aligned words, then that
with the better coverage, then the first place; equal rows and rows of one doc_id or
none stay, each with its own result; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm import tokens

# Wording of public licenses and notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
# Words too plain to point to a license.
PLAIN = set("a an and any any are as at be by for form free from if in is it later not of on one or other that the this to under use used was with without work you file copy".split()) | set("0123456789")

THRESHOLD = 0.8
#: A license takes at most so many times its template's length.
SPREAD = 6
#: Gaps without anchors of at most so many word pairs are aligned by the longest common subsequence.
SMALL_GAP = 1024
WORDS = "alnum"


def words_of(text: str) -> tokens.Words:
    data = np.frombuffer(text.encode(), np.uint8)
    return tokens.Words(data, np.array([0, len(data)]), WORDS)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first number, whose second numbers increase (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[k], piles[k] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(template: list[int], text: list[int]) -> list[tuple[int, int]]:
    """Matched places (template, text), increasing in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(template), 0, len(text))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and template[a] == text[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        mine, theirs = Counter(template[a:b]), Counter(text[c:d])
        once = {x: i for i, x in enumerate(text[c:d], c) if theirs[x] == 1 and mine[x] == 1}
        kept = increasing([(i, once[x]) for i, x in enumerate(template[a:b], a) if mine[x] == 1 and x in once])
        at, to = a, c
        for i, j in kept:
            if i < at or j < to:
                continue
            lo, lj = i, j
            while lo > at and lj > to and template[lo - 1] == text[lj - 1]:
                lo, lj = lo - 1, lj - 1
            hi, hj = i + 1, j + 1
            while hi < b and hj < d and template[hi] == text[hj]:
                hi, hj = hi + 1, hj + 1
            out += zip(range(lo, hi), range(lj, hj))
            gaps.append((at, lo, to, lj))
            at, to = hi, hj
        if kept:
            gaps.append((at, b, to, d))
        elif (b - a) * (d - c) <= SMALL_GAP:
            out += longest(template, text, a, b, c, d)
    return sorted(out)


def longest(template: list[int], text: list[int], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """The longest common run, not necessarily without gaps, of template[a:b] and text[c:d], of a bounded size."""
    best = np.zeros((b - a + 1, d - c + 1), np.int32)
    for i in range(b - a - 1, -1, -1):
        for j in range(d - c - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if template[a + i] == text[c + j] else max(best[i + 1, j], best[i, j + 1])
    out, i, j = [], 0, 0
    while i < b - a and j < d - c:
        if template[a + i] == text[c + j]:
            out.append((a + i, c + j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def unstray(matches: list[tuple[int, int]], at: list[int], n: int) -> list[tuple[int, int]]:
    """The matches of a template of n words without few words at either end that stand far from the rest."""
    few = max(2, n // 10)
    gaps = [i for i in range(1, len(matches)) if at[matches[i][1]] - at[matches[i - 1][1]] > max(n / 2, 3)]
    lo = max([i for i in gaps if i <= few], default=0)
    hi = min([i for i in gaps if i >= len(matches) - few and i > lo], default=len(matches))
    return matches[lo:hi]


class Scanner:
    """The templates ready for use in a task."""

    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD, spread: int = SPREAD):
        self.threshold, self.spread, self.names = threshold, spread, list(templates)
        words = [words_of(t).hash for t in templates.values()]
        self.every, flat = np.unique(np.concatenate(words) if words else np.zeros(0, np.uint64), return_inverse=True)
        ends = np.cumsum([0, *map(len, words)])
        self.words = [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]
        self.times = np.array([np.bincount(w, minlength=len(self.every)) for w in self.words]).reshape(len(words), -1)
        plain = np.isin(self.every, words_of(" ".join(sorted(PLAIN))).hash)
        # a text without telling words can't reach the threshold where a template's share of plain words is below it
        self.telling = [{x for x in w if not plain[x]} if sum(plain[w]) < threshold * len(w) else set(w) for w in self.words]
        self.marks = np.isin(np.arange(len(self.every)), sorted(set().union(*self.telling)))

    def places(self, k: int, at: list[int], words: list[int]) -> list[tuple[int, float, int, int]]:
        """(aligned words, coverage, first word, word after the last) of each place of a template, in a text's words ``words`` at ``at``."""
        template, telling, out = self.words[k], self.telling[k], []
        n, own = len(template), set(self.words[k])
        left = [(p, w) for p, w in zip(at, words) if w in own]
        need = Counter(template)
        while True:
            have = Counter(w for _, w in left)
            if (have & need).total() < self.threshold * n:
                return out
            rare = sorted((w for w in have if w in telling), key=lambda w: (have[w], template.index(w)))
            used: set[int] = set()
            # the closest words first
            for reach, mark in ((r, w) for r in (1.5 * n, 3 * n, self.spread * n) for w in rare):
                marks = [i for i, (_, w) in enumerate(left) if w == mark]
                for before, i, after in zip([-1, *marks], marks, [*marks[1:], len(left)]):
                    near = [j for j in range(before + 1, after) if j not in used and abs(left[j][0] - left[i][0]) <= reach]
                    got = unstray(align(template, [left[j][1] for j in near]), [left[j][0] for j in near], n)
                    if len(got) >= self.threshold * n:
                        first, last = left[near[got[0][1]]][0], left[near[got[-1][1]]][0]
                        if last - first < self.spread * n:
                            used |= {near[j] for _, j in got}
                            out.append((len(got), len(got) / n, first, last + 1))
                if used:
                    break
            if not used:
                return out
            left = [x for i, x in enumerate(left) if i not in used]

    def found(self, at: np.ndarray, words: np.ndarray) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, start, end, aligned words) of all templates in a text, by their place."""
        share = np.minimum(self.times, np.bincount(words, minlength=len(self.every))).sum(axis=1)
        all_: list[tuple] = []
        for k in np.flatnonzero(share >= self.threshold * self.times.sum(axis=1)).tolist():
            all_ += [(-m, -c, k, a, b) for m, c, a, b in self.places(k, at.tolist(), words.tolist())]
        out: list[tuple] = []
        for m, c, k, a, b in sorted(all_):
            if all(b <= x[2] or a >= x[3] for x in out):
                out.append((self.names[k], -c, a, b, -m))
        return sorted(out, key=lambda x: x[2])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, spread: int = SPREAD) -> DataFrame:
    """(doc_id, license, coverage, start, end, found) of every row: the license with most aligned words, its
    coverage and place in words, else nulls; ``found``: all licenses of the text, by their place."""
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(templates, threshold, spread)
        one = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            for rows, w in tokens.slices(batch, "text", WORDS):
                every: list[list[tuple]] = [[] for _ in range(w.n_rows)]
                if len(s.every) and len(w.hash):
                    at = np.minimum(np.searchsorted(s.every, w.hash), len(s.every) - 1)
                    hit = np.flatnonzero(s.every[at] == w.hash)
                    where = np.searchsorted(hit, w.first)
                    told = np.searchsorted(hit[s.marks[at[hit]]], w.first)
                    for i in np.flatnonzero(np.diff(told)).tolist():
                        h = hit[where[i] : where[i + 1]]
                        every[i] = s.found(h - w.first[i], at[h])
                best = [max(x, key=lambda f: (f[4], f[1], -f[2]))[:4] if x else (None,) * 4 for x in every]
                cols = list(zip(*best)) if best else [()] * 4
                lists = [[dict(zip(("license", "coverage", "start", "end"), f)) for f in x] for x in every]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(rows.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(lists, pa.list_(one))],
                    ["doc_id", "license", "coverage", "start", "end", "found"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, start int, end int, found array<struct<license:string,coverage:double,start:int,end:int>>")
