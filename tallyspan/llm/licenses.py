"""Licence scans by a trained paragraph classifier.

A multinomial logistic regression over sparse word n-grams names the licence family of a paragraph, with
a class of its own for everything else and probabilities calibrated on held-out paragraphs. A
prediction counts once the paragraph also matches one of the family's templates word for word
to the usual degree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .tokens import FOLD, hashes, sequence_hash, texts, words

#: Short notices and opening passages of well-known public licences.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "SPDX-License-Identifier: Zlib",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "public-domain": (
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}
UNKNOWN = "unknown"
#: Documents whose paragraphs teach the class ``unknown``, at most; by hash of their id.
MOST_DOCUMENTS = 500
MOST_PARAGRAPHS = 3_000
#: Characters of a line that teaches that class, at most: it bounds what the driver is sent. All lines are scanned.
MOST_CHARACTERS = 2_000
#: Words that a training copy of a template loses or swaps, at most this share.
NOISE = 0.15
COPIES = 24
#: Share of held-out unknown paragraphs that may pass the probability level.
FALSE_RATE = 0.002
SHINGLE, SIMILARITY = 5, 0.75

APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
NEWLINE = ord("\n")


def tokens(text: str) -> list[str]:
    """Runs of ASCII letters and digits, lower-cased."""
    return re.findall(r"[a-z0-9]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text))


def grams(ws: list[str]) -> set[str]:
    return {" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)}


def shingle_set(ws: list[str]) -> set[tuple]:
    return {tuple(ws[i : i + SHINGLE]) for i in range(len(ws) - SHINGLE + 1)} if len(ws) > SHINGLE else {tuple(ws)}


@dataclass
class Model:
    """Vocabulary, weights (n-grams x classes), temperature and the level that a prediction needs."""

    classes: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    level: float = 0.5
    shingles: dict[str, list[tuple[str, set]]] = field(default_factory=dict)

    def logits(self, ws: list[str]) -> np.ndarray:
        at = [self.vocabulary[g] for g in grams(ws) if g in self.vocabulary]
        return self.bias + (self.weights[at].sum(axis=0) / np.sqrt(len(at)) if at else 0)

    def predict(self, ws: list[str]) -> tuple[str, float]:
        z = self.logits(ws) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        if self.classes[best] == UNKNOWN or p[best] < self.level:
            return UNKNOWN, float(p[-1])
        return self.classes[best], float(p[best])

    def confirm(self, family: str, ws: list[str]) -> tuple[str, float]:
        """The family's template with the largest share of its shingles in the paragraph, and that share."""
        found = {n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} for n in range(1, SHINGLE + 1)}
        shares = [(len(s & found[len(next(iter(s)))]) / len(s), name) for name, s in self.shingles[family]]
        share, name = max(shares, key=lambda x: (x[0], x[1]))
        return name, share


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(background: list[str], steps: int = 400) -> Model:
    """Fit on noisy copies of the templates against background paragraphs and shuffled template words."""
    rng = np.random.default_rng(5)
    classes = [*TEMPLATES, UNKNOWN]
    plain = [tokens(p) for p in background][:MOST_PARAGRAPHS]
    filler = np.array([w for ws in plain for w in ws] or ["lorem"])
    pick = lambda source, n: source[rng.integers(0, len(source), n)].tolist()
    samples: list[tuple[list[str], int]] = []
    every_word = np.array(sorted({w for ts in TEMPLATES.values() for t in ts for w in tokens(t)}))
    for c, family in enumerate(TEMPLATES):
        for t in TEMPLATES[family]:
            ws = tokens(t)
            for copy in range(COPIES):
                kept = [w if rng.random() > NOISE * (copy > 0) else pick(filler, 1)[0] for w in ws]
                around = pick(filler, rng.integers(0, 20)) if copy % 2 else []
                cut = int(rng.integers(0, len(around) + 1))
                samples.append(([*around[:cut], *kept, *around[cut:]], c))
    samples += [(ws, len(classes) - 1) for ws in plain]
    samples += [(pick(every_word if i % 2 else filler, rng.integers(3, 25)), len(classes) - 1) for i in range(600)]
    vocabulary = {g: i for i, g in enumerate(sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(tokens(t))}))}
    x = np.zeros((len(samples), len(vocabulary)), np.float32)
    for i, (ws, _) in enumerate(samples):
        at = [vocabulary[g] for g in grams(ws) if g in vocabulary]
        x[i, at] = 1 / np.sqrt(len(at)) if at else 0
    y = np.array([c for _, c in samples])
    held = rng.random(len(y)) < 0.25
    goal = np.eye(len(classes), dtype=np.float32)[y]
    w, b = np.zeros((x.shape[1], len(classes)), np.float32), np.zeros(len(classes), np.float32)
    xt, gt, rate = x[~held], goal[~held], 4.0
    for _ in range(steps):
        slope = softmax(xt @ w + b) - gt
        w -= rate * (xt.T @ slope / len(xt) + 1e-5 * w)
        b -= rate * slope.mean(axis=0)
    z, yh = x[held] @ w + b, y[held]
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: -np.log(softmax(z / t)[np.arange(len(yh)), yh] + 1e-12).mean())
    wrong = softmax(z / temperature)[yh == len(classes) - 1, :-1].max(axis=1, initial=0)
    level = float(np.quantile(wrong, 1 - FALSE_RATE)) if len(wrong) else 0.5
    template_shingles = {f: [(t, shingle_set(tokens(t))) for t in ts] for f, ts in TEMPLATES.items()}
    return Model(classes, vocabulary, w, b, temperature, level, template_shingles)


def run_hash(ws: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(ws).encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), APART)
    return sequence_hash(hashes(data, starts, ends), len(ws))[:1]


def run_hashes(strings: list[list[str]]) -> np.ndarray:
    """Hashes of word runs, as the scan computes them."""
    return np.unique(np.concatenate([run_hash(ws) for ws in strings]))


def judged(model: Model, said: str) -> tuple[str, float, str, float] | None:
    """Family, probability, template and similarity of a paragraph that is predicted and confirmed."""
    ws = tokens(said)
    if len(ws) < 3:
        return None
    family, p = model.predict(ws)
    if family == UNKNOWN:
        return None
    template, share = model.confirm(family, ws)
    return (family, p, template, share) if share >= SIMILARITY else None


def best_run(model: Model, lines: list[str]) -> tuple[int, int, tuple] | None:
    """First and last line, and verdict, of the run with the largest similarity that starts at the first line or, if
    leading lines add nothing, below it; of equal ones the shortest."""
    best = None
    for last in range(1, len(lines)):
        verdict = judged(model, "\n".join(lines[: last + 1]))
        if verdict and (best is None or verdict[3] > best[2][3]):
            best = (0, last, verdict)
    if best is None:
        return None
    first, last, verdict = best
    while first < last:
        less = judged(model, "\n".join(lines[first + 1 : last + 1]))
        if less is None or less[3] < verdict[3]:
            break
        first, verdict = first + 1, less
    return first, last, verdict


#: A notice can stand anywhere in a paragraph of running words: a window is where a template would lie by this share of its
#: three-word runs or more, whose places agree but for so many words, with a margin of words on both sides.
VOTES, DRIFT, MARGIN = 0.3, 4, 4
#: A line of more words is judged by its windows where they hold notices.
LONG = 40


class Windows:
    """Where templates would lie in a text, by the three-word runs that both have."""

    def __init__(self) -> None:
        every = [tokens(t) for ts in TEMPLATES.values() for t in ts]
        places = [(k, i) for k, ws in enumerate(every) for i in range(len(ws) - 2)]
        h = np.concatenate([run_hash(every[k][i : i + 3]) for k, i in places])
        order = np.argsort(h, kind="stable")
        self.run, self.template, self.offset = h[order], *(np.array(x)[order] for x in zip(*places))
        self.size = np.array([len(ws) for ws in every])

    def found(self, runs: np.ndarray, block: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(first word, end, first matching word, last): windows of words; ``block`` numbers what a window stays within."""
        lo, hi = np.searchsorted(self.run, runs, "left"), np.searchsorted(self.run, runs, "right")
        hit = np.flatnonzero((hi > lo) & (block[: len(runs)] == block[2 : len(runs) + 2]))
        n = (hi - lo)[hit]
        word = np.repeat(hit, n)
        entry = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + lo[word]
        template, start = self.template[entry], word - self.offset[entry]
        order = np.lexsort((word, start, template, block[word]))
        word, template, start = word[order], template[order], start[order]
        of = block[word]
        new = np.ones(len(word), bool)
        new[1:] = (of[1:] != of[:-1]) | (template[1:] != template[:-1]) | (start[1:] - start[:-1] > DRIFT)
        at = np.flatnonzero(new)
        out = []
        for a, z in zip(at, np.append(at[1:], len(word))):
            size = self.size[template[a]]
            if len(np.unique(word[a:z])) >= VOTES * (size - 2):
                first, end = np.searchsorted(block, of[a], "left"), np.searchsorted(block, of[a], "right")
                out.append((int(max(first, start[a] - MARGIN)), int(min(end, start[z - 1] + size + MARGIN)), int(word[a:z].min()), int(word[a:z].max()) + 2))
        return out


def scan_batches(model: Model):
    """Lines with a run of three template words, and runs of adjacent lines from these on, classified and confirmed; then
    windows of what is left, for notices that stand in longer paragraphs.

    No other paragraph could be confirmed: a template's shingles are runs of three words and more. A run is as
    long as a template that starts in its first line can reach, and ends at a line without words or one that holds
    a whole template by itself. Windows don't reach over lines without words.
    """
    windows = Windows()
    every = [tokens(t) for ts in TEMPLATES.values() for t in ts]
    triples = run_hashes([ws[i : i + 3] for ws in every for i in range(len(ws) - 2)])
    most = max(map(len, every))
    schema = ["doc_id", "paragraph", "start", "end", "family", "probability", "template", "similarity"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.float64())

    def of(batches):
        for batch in batches:
            rows, ids = [], batch.column("doc_id").to_pylist()
            for first, _, data, bounds in texts(batch.column("text")):
                starts, ends, at = words(FOLD[data], bounds, APART)
                if len(starts) < 3:
                    continue
                runs = sequence_hash(hashes(FOLD[data], starts, ends), 3)
                known = triples[np.minimum(np.searchsorted(triples, runs), len(triples) - 1)] == runs
                breaks = np.flatnonzero(data == NEWLINE)
                edges = np.union1d(breaks, bounds)  # a line lies between two neighbours

                def line(e):
                    a, z = int(edges[e - 1]), int(edges[e]) if e < len(edges) else len(data)
                    return a + int(data[a] == NEWLINE), z

                def said(e):
                    a, z = line(e)
                    return data[a:z].tobytes().decode("utf-8", "replace")

                def text_of(e):
                    return int(np.searchsorted(bounds, edges[e - 1], "right")) - 1

                lines_before = np.searchsorted(breaks, starts)  # a word's line, over all texts of the slice
                block = np.repeat(np.arange(len(at) - 1), np.diff(at)) * 2
                block[1:] += np.cumsum(lines_before[1:] - lines_before[:-1] >= 2) * 2
                inside, used = [], []
                for a, z, i, j in windows.found(runs, block):
                    if verdict := judged(model, data[starts[a] : ends[z - 1]].tobytes().decode("utf-8", "replace")):
                        inside.append((-verdict[3], i, j, verdict))
                inside.sort(key=lambda w: (w[0], w[1] - w[2], w[1]))  # of equal ones the longest

                def long(e):
                    """Whether a line is to be judged by windows: it has many words, and a notice among them."""
                    a, z = line(e)
                    own = slice(np.searchsorted(starts, a), np.searchsorted(starts, z))
                    return own.stop - own.start > LONG and any(own.start <= i and j < own.stop for _, i, j, _ in inside)

                def report(e, last, verdict, a=None, z=None):
                    a, z = (line(e)[0], line(last)[1]) if a is None else (a, z)
                    used.append((a, z))
                    text = text_of(e)
                    begin = int(bounds[text])
                    start = len(data[begin:a].tobytes().decode("utf-8", "replace"))
                    number = int(np.count_nonzero(data[begin:a] == NEWLINE))
                    rows.append((ids[first + text], number, start, start + len(data[a:z].tobytes().decode("utf-8", "replace")), *verdict))

                hits = np.unique(np.searchsorted(edges, starts[np.flatnonzero(known)], "right")).tolist()
                alone = {e: v for e in hits if (v := judged(model, said(e)))}
                taken = 0
                for e in hits:
                    if e <= taken or long(e):
                        continue
                    own = alone.get(e)
                    found = None
                    if own is None or own[3] < 1:
                        lines, after, k = [said(e)], 0, e + 1
                        while after < most and k < len(edges) and (k not in alone or alone[k][3] < 1) and text_of(k) == text_of(e) and (ws := tokens(said(k))):
                            lines.append(said(k))
                            after += len(ws)
                            k += 1
                        found = best_run(model, lines)
                    if found and (own is None or found[2][3] > own[3]):
                        report(e + found[0], e + found[1], found[2])
                        taken = e + found[1]
                    elif own:
                        report(e, e, own)
                for _, i, j, verdict in inside:  
                    a, z = int(starts[i]), int(ends[j])
                    if all(z <= x or y <= a for x, y in used):
                        e = int(np.searchsorted(edges, a, "right"))
                        report(e, e, verdict, a, z)
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema)

    return of


def fit(docs: DataFrame) -> Model:
    """Train with paragraphs of MOST_DOCUMENTS documents (first by hash of id) as background."""
    chosen = docs.where("text is not null").select(F.col("doc_id").alias("chosen_id")).orderBy(F.xxhash64("chosen_id"), "chosen_id").limit(MOST_DOCUMENTS)
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"))  # MOST_DOCUMENTS ids
    lines = some.select(F.explode(F.split("text", "\n")).alias("p")).where(F.length("p") <= MOST_CHARACTERS)
    lines = lines.orderBy(F.xxhash64("p"), "p").limit(MOST_PARAGRAPHS).collect()
    known = [" ".join(tokens(t)) for ts in TEMPLATES.values() for t in ts]
    background = [r["p"] for r in lines]
    said = [" ".join(tokens(p)) for p in background]
    return train([p for p, ws in zip(background, said) if not any(k in ws for k in known)])


def find_licences(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per confirmed licence paragraph: doc_id, paragraph, start, end, family, probability, template, similarity.

    Texts are read whole, however long; columns of any other name, clashing or not, are left out of the result.

    Paragraphs are lines, runs of adjacent lines that hold a notice together, or windows around the three-word runs of a
    template, in lines of any length; ``paragraph`` is the first line, counted from 0; start and end are code points, end exclusive. A null or empty
    text has none; a null doc_id is carried along; rows that repeat are scanned each on its own; no rows, no
    paragraphs. Of equal scores the first family in the list wins.
    """
    model = model or fit(docs)
    schema = "doc_id long, paragraph long, start long, end long, family string, probability double, template string, similarity double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan_batches(model), schema)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licences(load(spark, sf_dir, "documents"))


QUERIES = {"op2_licenses": op2_licenses}
ORACLE_SQL: dict[str, str] = {}
