"""Licence scans: a trained paragraph classifier, confirmed against templates.

Paragraphs are runs of lines that have words, and also each line alone, so that a notice counts
whether it is wrapped or stands among other lines. A multinomial logistic regression over hashed word unigrams and
bigrams tells the licence family of a window of at most WINDOW words, one class being "unknown". It
is trained here: on the notices below, and on each name of a licence in several phrases, cut and
disturbed by fixed rules; for the unknown class, on lines of the corpus and on licence words out of
order. Its temperature is fitted on wordings kept apart, every fifth notice and phrase with all its
disturbed copies. Every window of every document is scored. One counts when the calibrated probability that it
holds a licence reaches `sure`; the classifier then names the families, those that it gives at least
`likely`. Templates only confirm: a named family stays where `cover` or more of the bigrams of one of its
templates are in the window (all of them, of templates with three or fewer; one that only its name has, where the
template holds the name); the best covered one is taken, and what stands before and after it is scored and
named again. So a window may hold several families, and one whose families all fail is unknown.

The unknown class is fitted on at most SAMPLE_LINES lines of each of the `sample` documents whose
hashed ids are smallest, on licence words out of order, and on PROSE, which uses them in other senses. Bigrams
don't run over the end of a sentence.

Defined cases: null and empty texts have one empty line and no licence; a line may hold several
families, each reported once with its best window; a notice over several lines is reported at the
line where its window starts, unless one of the lines has been reported for the family alone; ties go to the family that comes first in
FAMILIES; repeated rows and rows without id are scanned each; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .decontaminate import _GAPS
from .textbatch import LOWER, buffer_of, mix, slices, tidy, word_hashes, words_of

WINDOW, STRIDE = 40, 20
FEATURES = 1 << 15

# Short notices by which public licences name themselves.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
        "License: MIT",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Released under the Apache 2.0 license.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "License: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Released under the GNU GPL v3.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "License: GPL-3.0",
    ),
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "isc": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "SPDX-License-Identifier: ISC",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "zlib": (
        "Licensed under the zlib License.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "SPDX-License-Identifier: Zlib",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "bsd": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under the Creative Commons BY-NC-SA license.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "Released into the public domain by its authors.",
        "This file is placed in the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "All rights are reserved.",
        "Copyright by the authors. All rights reserved. No part of this publication may be reproduced without prior permission.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ),
}
# What licences are called in running text.
NAMES = {
    "mit": ("MIT License", "MIT licence", "Expat License"),
    "apache": ("Apache License", "Apache License 2.0", "Apache Software License", "Apache 2.0 licence"),
    "gpl": ("GNU General Public License", "GNU GPL", "GPL version 3", "GPLv3 license", "GPL license"),
    "agpl": ("GNU Affero General Public License", "GNU AGPL", "AGPL version 3"),
    "isc": ("ISC License", "ISC licence"),
    "epl": ("Eclipse Public License", "Eclipse Public License 2.0"),
    "zlib": ("zlib License", "zlib licence", "zlib/libpng License"),
    "lgpl": ("GNU Lesser General Public License", "GNU LGPL", "LGPL version 2.1", "LGPL license"),
    "bsd": ("BSD License", "BSD licence", "3-Clause BSD License", "BSD 2-Clause License"),
    "mpl": ("Mozilla Public License", "Mozilla Public License 2.0"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "Creative Commons BY-NC"),
    "cc-by": ("Creative Commons Attribution 4.0", "Creative Commons Attribution", "CC BY 4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike"),
    "public-domain": ("CC0 1.0", "Creative Commons Zero", "Unlicense for the public domain"),
}
PHRASES = (
    "{}", "under the {}", "Provided under the {}.", "This package is offered under the terms of the {}",
    "The code is licensed under the {}", "released under {}", "available under a {} licence", "subject to the {}, see the file for details",
)
#: Other uses of the names: what follows a name then tells.
ELSEWHERE = ("{} plates", "{} fees were paid", "the {} holder was fined", "{} exam on Monday", "{} office hours", "their {} number expired")
# Prose that holds licences' words and names in other senses.
PROSE = (
    "He has a licence to fish in the river.", "The driving licence was renewed for a fee.", "She studied at MIT and paid licence fees.", "MIT license plates were stolen from the car.",
    "The Apache people had no licence to hunt there.", "The general public has a license to enter the park.", "The public domain of the village was sold.", "A BSD conference issued license badges.",
    "Creative work in common rooms needs attribution.", "All seats are reserved on the right.", "The rights of the king were reserved by law.", "Permission was granted to any person who came.",
    "Eclipse watchers need a public permit.", "An ISC officer read the license aloud.", "The Mozilla office is open to the public.", "The TV licence pays for public radio.",
    "Distribution of food and use of water are permitted.", "This program is on free television in general.", "The software company lost its licence to sell.", "Redistribution of land was permitted by the state.",
)
FAMILIES = tuple(TEMPLATES)
SAMPLE_LINES = 20
#: Bigrams up to which a template must be there whole.
SHORT = 3
UNKNOWN = len(FAMILIES)


_STOPS, _SPACES = np.frombuffer(b".!?", np.uint8), np.frombuffer(b" \n\t\r", np.uint8)


def word_features(texts: list[bytes]):
    """(line begins in words, unigram slots, bigram slots, bigram hashes, line owner, number of lines a text).

    A bigram stands at its first word; the last word of a line has none, marked by slot -1.
    """
    buf, starts = buffer_of(texts)
    low = LOWER[buf]
    begins, ends = words_of(low, _GAPS)
    h = word_hashes(low, begins, ends)
    breaks = np.flatnonzero(buf == 10)
    at = np.union1d(starts, breaks + 1)
    at = at[at < len(buf)]
    cut = np.append(np.searchsorted(begins, at), len(begins))
    owner = np.searchsorted(starts, at, side="right") - 1
    one = (h % np.uint64(FEATURES)).astype(np.int32)
    pair = np.zeros(len(h), np.uint64)
    pair[:-1] = mix(h[:-1] * np.uint64(3) + h[1:])
    two = (pair % np.uint64(FEATURES)).astype(np.int32)
    last = cut[1:][cut[1:] > cut[:-1]] - 1
    two[last] = -1
    after = np.minimum(ends, len(buf) - 1)
    stop = np.isin(buf[after], _STOPS) & np.isin(buf[np.minimum(after + 1, len(buf) - 1)], _SPACES)
    two[stop], pair[stop] = -1, 0
    return cut, one, two, pair, owner, np.bincount(owner, minlength=len(texts))


def windows_of(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, first word, end word) of the windows of all lines that have words."""
    size = np.diff(cut)
    many = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
    line = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many)
    first = cut[line] + nth * STRIDE
    return line, first, np.minimum(first + WINDOW, cut[line + 1])


def paragraphs(cut: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line, end line) of the runs of two lines or more that have words."""
    some = np.diff(cut) > 0
    follows = np.zeros(len(some), bool)
    follows[1:] = some[1:] & some[:-1] & (owner[1:] == owner[:-1])
    first = np.flatnonzero(some & ~follows)
    breaks = np.append(np.flatnonzero(~follows), len(some))
    end = breaks[np.searchsorted(breaks, first, side="right")]
    return first[end - first > 1], end[end - first > 1]


def wrapped(cut: np.ndarray, pair: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, bigram slots) of windows of paragraphs; bigrams run over line ends."""
    line, stop = paragraphs(cut, owner)
    begin, end = cut[line], cut[stop]
    nth, first, last = windows_of(np.stack((begin, end), axis=1).ravel()) if len(line) else (np.zeros(0, int),) * 3
    own = nth % 2 == 0  # the others lie between paragraphs
    slots = (pair % np.uint64(FEATURES)).astype(np.int32)
    slots[pair == 0] = -1  # a sentence ends there
    return first[own], last[own], slots


def shortest_span(own: np.ndarray, template: np.ndarray) -> tuple[int, int]:
    """(begin, end) of the shortest stretch of bigrams that has all those of `template` that are there."""
    at = np.flatnonzero(np.isin(own, template))
    missing = len(np.unique(own[at]))
    held: dict[int, int] = {}
    best, first = (0, len(own)), 0
    for i in at:
        held[own[i]] = held.get(own[i], 0) + 1
        while len(held) == missing:
            if i + 1 - at[first] < best[1] - best[0]:
                best = (int(at[first]), int(i) + 1)
            left = own[at[first]]
            held[left] -= 1
            if not held[left]:
                del held[left]
            first += 1
    return best


def confirmed(own: np.ndarray, pairs: list[list[tuple[np.ndarray, frozenset, frozenset]]], cover: float, named: list[int]) -> tuple[int, float, int, int] | None:
    """(family, cover, begin, end) of the best covered of the `named` families in a window's bigrams, and where it stands; None if none is."""
    best, there = (0.0, 0, 0.0, own), set(own.tolist())
    for family in named:
        for t, whole, name in pairs[family]:
            held = len(whole & there)
            share = held / len(whole)
            if name and not name & there:
                continue  # words of a relative's notice
            if share >= (cover if len(whole) > SHORT else 1.0) and (share * held, -family) > (best[0], -best[1]):
                best = (share * held, family, share, t)
    return (best[1], best[2], *shortest_span(own, best[3])) if best[0] else None


def logits(first: np.ndarray, end: np.ndarray, one: np.ndarray, two: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Class scores of windows; weights has a last row of zeros for slot -1."""
    n = end - first
    starts = np.cumsum(n) - n
    flat = np.arange(int(n.sum())) - np.repeat(starts - first, n)
    pairs = two[flat]
    pairs[starts + n - 1] = -1  # the bigram over a window's end isn't its own
    sums = np.add.reduceat(weights[one[flat]] + weights[pairs], starts, axis=0).astype(np.float64)
    return sums / np.sqrt(np.maximum(2 * n - 1, 1))[:, None] + bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def wordings(family: str) -> list[str]:
    """The family's notices, and its names in every phrase."""
    return [*TEMPLATES[family], *(phrase.format(name) for name in NAMES.get(family, ()) for phrase in PHRASES)]


def examples(lines: list[str], rng: np.random.Generator) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Training paragraphs, their classes and wordings: disturbed notices, corpus lines, shuffled words."""
    filler = [w for line in lines for w in line.split()] or ["lorem", "ipsum", "dolor"]
    texts, labels, wording = [], [], []
    for label, family in enumerate(FAMILIES):
        for number, template in enumerate(wordings(family)):
            words = template.split()
            for turn in range(24 if template in TEMPLATES[family] else 6):
                wording.append(number)
                own = list(words)
                if turn % 3 and len(own) > 4:
                    own = [w for w in own if rng.random() > 0.08] or own
                if turn % 2:
                    pad = [filler[i] for i in rng.integers(0, len(filler), rng.integers(1, 30))]
                    own = pad + own if turn % 4 == 1 else own + pad
                texts.append(" ".join(own))
                labels.append(label)
    every = [w for ts in TEMPLATES.values() for t in ts for w in t.split()]
    for _ in range(400):
        few = [every[i] for i in rng.integers(0, len(every), rng.integers(1, 5))]
        more = [filler[i] for i in rng.integers(0, len(filler), rng.integers(3, 25))]
        texts.append(" ".join(rng.permutation(few + more)))
        labels.append(UNKNOWN)
    for sentence in PROSE:  # alone, and within lines of the corpus
        for turn in range(6):
            pad = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 20))] if turn else []
            texts.append(" ".join([*pad, *sentence.split()]))
            labels.append(UNKNOWN)
    for phrase in ELSEWHERE:
        for name in (n for names in NAMES.values() for n in names[:2]):
            texts.append(phrase.format(name))
            labels.append(UNKNOWN)
    texts += lines
    labels += [UNKNOWN] * len(lines)
    wording += range(len(texts) - len(wording))
    return [t.encode() for t in texts], np.array(labels), np.array(wording)


def fit(lines: list[str], steps: int = 150, ridge: float = 2e-4, seed: int = 7):
    """(weights with a zero row at the end, bias, temperature)."""
    texts, labels, wording = examples(lines, np.random.default_rng(seed))
    cut, one, two, _, _, _ = word_features([t.replace(b"\n", b" ") for t in texts])
    first, end = cut[:-1], cut[1:]
    some = end > first
    owner = np.repeat(np.arange(len(texts)), end - first)
    slot = np.concatenate((one, two))
    row = np.concatenate((owner, owner))
    row, slot = row[slot >= 0], slot[slot >= 0]
    scale = 1 / np.sqrt(np.maximum(2 * (end - first) - 1, 1))
    k = UNKNOWN + 1
    kept_apart = (wording % 5 == 4) & some
    train = ~kept_apart & some
    y = np.eye(k)[labels]
    share = np.bincount(labels[train], minlength=k)
    weight = np.where(train, 1.0 / np.maximum(share[labels], 1), 0) / k
    used, spot = np.unique(slot, return_inverse=True)
    order = np.argsort(spot, kind="stable")
    spot_cut = np.searchsorted(spot[order], np.arange(len(used)))
    w, b = np.zeros((len(used), k)), np.zeros(k)
    moment = [np.zeros_like(w), np.zeros_like(w)]
    row_order = np.argsort(row, kind="stable")
    rows_there, row_cut = np.unique(row[row_order], return_index=True)

    def score(w, b):
        z = np.zeros((len(texts), k))
        z[rows_there] = np.add.reduceat(w[spot[row_order]], row_cut, axis=0)
        return z * scale[:, None] + b

    for t in range(1, steps + 1):
        g = (softmax(score(w, b)) - y) * weight[:, None]
        gw = np.add.reduceat((g * scale[:, None])[row[order]], spot_cut, axis=0) + ridge * w / k
        moment[0] = 0.9 * moment[0] + 0.1 * gw
        moment[1] = 0.99 * moment[1] + 0.01 * gw**2
        w -= 0.1 * (moment[0] / (1 - 0.9**t)) / (np.sqrt(moment[1] / (1 - 0.99**t)) + 1e-8)
        b -= 0.5 * g.sum(axis=0)
    z = score(w, b)[kept_apart]
    known = labels[kept_apart]
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(z)), known] + 1e-12).mean()
    temperature = min((0.25 * 1.15**i for i in range(20)), key=loss)
    weights = np.zeros((FEATURES + 1, k), np.float32)
    weights[used] = w
    return weights, b, temperature


def template_pairs() -> list[list[tuple[np.ndarray, frozenset, frozenset]]]:
    """For each family the bigram hashes of each template, twice, and those of them that only this family's names have."""

    def bigrams(text: str) -> np.ndarray:
        _, _, two, pair, _, _ = word_features([text.encode()])
        return np.unique(pair[two >= 0])

    named = [np.unique(np.concatenate([bigrams(n) for n in NAMES.get(f, ())] or [np.zeros(0, np.uint64)])) for f in FAMILIES]
    out = []
    for i, family in enumerate(FAMILIES):
        own = np.setdiff1d(named[i], np.concatenate([n for j, n in enumerate(named) if j != i]))
        out.append([(t, frozenset(t.tolist()), frozenset(np.intersect1d(t, own).tolist())) for t in map(bigrams, (*TEMPLATES[family], *NAMES.get(family, ())))])
    return out


SCHEMA = "doc_id long, n_lines long, n_licences long, families array<string>, found array<struct<line: long, family: string, probability: double, cover: double>>"
_FOUND = pa.list_(pa.struct([("line", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("cover", pa.float64())]))


def unknown_lines(docs: DataFrame, sample: int) -> list[str]:
    """Lines without licence words, cut to WINDOW words each, for the unknown class.

    They come from the `sample` rows whose hashed ids are smallest, SAMPLE_LINES from each: a fixed bound.
    """
    named = docs.where("text <> ''").select(F.xxhash64("doc_id").alias("h"), "text")
    last = named.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return []
    own = F.transform(F.split("text", "\n"), lambda x: F.array_join(F.slice(F.split(x, " "), 1, WINDOW), " "))
    short = F.transform(own, lambda x: F.substring(x, 1, 400))
    plain = F.filter(short, lambda x: (x != "") & ~F.lower(x).rlike("licen[cs]e|copyright|rights reserved|public domain|permission|redistribut|spdx|gpl|cc by|cc0|creative commons"))
    picked = F.slice(F.array_sort(F.transform(plain, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("line")))), 1, SAMPLE_LINES)
    # rows may repeat an id: the limit keeps their number
    rows = named.where(F.col("h") <= last).select("h", picked.alias("lines")).orderBy("h", "lines").limit(sample)
    return [x["line"] for r in rows.collect() for x in r["lines"]]


def scan_licences(docs: DataFrame, sample: int = 200, sure: float = 0.5, cover: float = 0.6, likely: float = 0.05) -> DataFrame:
    """Per row: doc_id, n_lines, n_licences, families (sorted), found (line, family, probability, cover)."""
    weights, bias, temperature = fit(unknown_lines(docs, sample))
    pairs = template_pairs()

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for first_row, end_row, texts in slices(batch):
                cut, one, two, pair, owner, n_lines = word_features(texts)
                _, first, end = windows_of(cut)
                more, more_end, over = wrapped(cut, pair, owner)
                scored = [logits(a, b, one, slots, weights, bias) for a, b, slots in ((first, end, two), (more, more_end, over)) if len(a)]
                p = softmax(np.concatenate(scored) / temperature) if scored else np.zeros((0, UNKNOWN + 1))
                first, end = np.concatenate((first, more)), np.concatenate((end, more_end))
                line, last = (np.searchsorted(cut, at, side="right") - 1 for at in (first, end - 1))
                found: list[dict] = [{} for _ in texts]
                told_at: dict[tuple[int, int], list[tuple[int, int]]] = {}
                line_at = np.cumsum(n_lines) - n_lines
                for w in np.flatnonzero(1 - p[:, UNKNOWN] >= sure):
                    doc = int(owner[line[w]])
                    slots = two if w < len(first) - len(more) else over
                    todo = [(int(first[w]), int(end[w]), p[w])]
                    while todo:
                        a, b, q = todo.pop()
                        named = np.flatnonzero(q[:UNKNOWN] >= likely).tolist() if 1 - q[UNKNOWN] >= sure else []
                        got = confirmed(pair[a : max(b - 1, a)], pairs, cover, named)
                        if got is None:
                            continue
                        family, share, begin, stop = got
                        # what stands before and after is scored alone
                        for x, y in ((a, a + begin), (a + stop + 1, b)):
                            if y - x > 1:
                                todo.append((x, y, softmax(logits(np.array([x]), np.array([y]), one, slots, weights, bias) / temperature)[0]))
                        spots = told_at.setdefault((doc, family), [])
                        if last[w] > line[w] and any(c <= last[w] and line[w] <= d for c, d in spots):
                            continue
                        spots.append((int(line[w]), int(last[w])))
                        key = (int(line[w] - line_at[doc]), family)
                        found[doc][key] = max(found[doc].get(key, (0.0, 0.0)), (float(q[family]), share))
                told = [[{"line": k[0], "family": FAMILIES[k[1]], "probability": v[0], "cover": v[1]} for k, v in sorted(f.items())] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first_row, end_row - first_row),
                        pa.array(n_lines, pa.int64()),
                        pa.array([len(f) for f in told], pa.int64()),
                        pa.array([sorted({x["family"] for x in f}) for f in told], pa.list_(pa.string())),
                        pa.array(told, _FOUND),
                    ],
                    names=["doc_id", "n_lines", "n_licences", "families", "found"],
                )

    return small_batches(docs).select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)
