"""Operator 5, licence scans: a trained paragraph classifier confirmed by templates.

Paragraphs (lines) are described by hashed word one- and two-grams; a sparse
multinomial logistic regression names a licence family or ``unknown``. Its
temperature and the least probability a family needs are calibrated on held-out
paragraphs, unknown ones among them. What it names is compared with the
family's templates, and only close paragraphs are confirmed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import LOWER, bounded_sample, chunks, flat, mix, prefix_hash, range_hash, tidied
from palimpsest.llm.toxicity import _OUTSIDE

SLOTS = 1 << 16
#: Lines of documents that stand for ``unknown`` in training.
BACKGROUND = 4000
#: Characters of a background line that training sees; scans read whole lines.
BACKGROUND_CHARS = 2000
#: Of the words of a template or of the paragraph, the share that must agree, in order.
CLOSE = 0.6
#: Of calibration paragraphs without a licence, the share that may pass.
FALSE_RATE = 0.002
UNKNOWN = "unknown"

#: Short notices in common use, one family each; words matter, not layout.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the terms of the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is distributed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person",
        "obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "You may modify it under the terms of the GNU General Public License.",
        "Distributed under the terms of the GNU General Public License version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute this library under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "This service is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the three-clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
#: Sentences that use licence words without granting one.
_NEAR_MISSES = [
    "The driver must carry a valid license at all times.",
    "The general public is welcome to the library on Sunday.",
    "She was free to use the software in any version she liked.",
    "The committee reserved all rooms under the name of the author.",
    "Copies of the work were distributed in compliance with the terms of the sale.",
    "This file is part of the archive and may be redistributed to the members.",
]
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def template_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines (row, start, end) that have a word, and (slot, line) of their grams."""
    n = len(off) - 1
    low = LOWER[data]
    cut = np.flatnonzero(data == 0x0A)
    lo = np.sort(np.concatenate([off[:-1], cut + 1]))
    hi = np.sort(np.concatenate([cut, off[1:]]))
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0x0A, out=total[1:])
    row = np.repeat(np.arange(n), total[off[1:]] - total[off[:-1]] + 1)
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = ~_OUTSIDE[low]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    edge = np.unique(off[1:-1])
    edge = edge[(edge > 0) & (edge < len(low))]
    edge = edge[(inside[edge] == 1) & (inside[edge + 1] == 1)]
    if len(edge):
        starts, ends = np.sort(np.append(starts, edge)), np.sort(np.append(ends, edge))
    line = np.searchsorted(lo, starts, side="right") - 1
    h = range_hash(prefix_hash(low), starts, ends)
    two = np.flatnonzero(line[1:] == line[:-1])
    pair = mix(h[two] * np.uint64(0x9FB21C651E98DF25) + h[two + 1]) if len(two) else np.zeros(0, np.uint64)
    slot = np.concatenate([h, pair])
    owner = np.concatenate([line, line[two]])
    return row, lo, hi, (slot & np.uint64(SLOTS - 1)).astype(np.int64), owner


class Classifier:
    """Weights over slots, calibrated temperature and least family probability."""

    def __init__(self, families: list[str]) -> None:
        self.families = [UNKNOWN, *families]
        self.weights = np.zeros((SLOTS, len(self.families)), np.float32)
        self.bias = np.zeros(len(self.families), np.float32)
        self.temperature, self.least = 1.0, 0.5

    def logits(self, slot: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        count = np.maximum(1, np.bincount(owner, minlength=n))
        order = np.argsort(owner, kind="stable")
        slot, owner = slot[order], owner[order]
        out = np.zeros((n, len(self.families)), np.float32)
        if len(slot):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[owner[first]] = np.add.reduceat(self.weights[slot], first, axis=0)
        return out / np.sqrt(count)[:, None].astype(np.float32) + self.bias

    def probabilities(self, slot: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        z = self.logits(slot, owner, n) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, lines: list[bytes], y: np.ndarray, rounds: int = 150) -> Classifier:
        slot, owner = _grams_of_lines(lines)
        n, c = len(lines), len(self.families)
        used, at = np.unique(slot, return_inverse=True)
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=n)))
        w, b = np.zeros((len(used), c)), np.zeros(c)
        m, v = np.zeros_like(w), np.zeros_like(w)
        weight = 1 / np.maximum(1, np.bincount(y, minlength=c))[y]
        weight *= n / weight.sum()
        target = np.eye(c)[y]
        for t in range(1, rounds + 1):
            z = np.stack([np.bincount(owner, w[at, k], n) for k in range(c)], 1) * scale[:, None] + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - target) * (weight / n)[:, None]
            e = d * scale[:, None]
            g = np.stack([np.bincount(at, e[owner, k], len(used)) for k in range(c)], 1) + 1e-5 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.2 * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            b -= 0.5 * d.sum(0)
        self.weights[used], self.bias = w, b.astype(np.float32)
        return self

    def calibrate(self, lines: list[bytes], y: np.ndarray) -> None:
        """Temperature by likelihood; the least probability by the false rate of unknowns."""
        slot, owner = _grams_of_lines(lines)
        z = self.logits(slot, owner, len(lines)).astype(np.float64)

        def loss(t: float) -> float:
            q = z / t - (z / t).max(1, keepdims=True)
            return float(-(q[np.arange(len(y)), y] - np.log(np.exp(q).sum(1))).mean())

        self.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        p = self.probabilities(slot, owner, len(lines))
        wrong = np.sort(p[y == 0, 1:].max(1))
        self.least = float(min(0.95, max(0.5, wrong[int((1 - FALSE_RATE) * (len(wrong) - 1))] if len(wrong) else 0.5)))


def _grams_of_lines(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat_lines = [x.replace(b"\n", b" ") for x in lines]
    data = np.frombuffer(b"".join(flat_lines), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in flat_lines])]).astype(np.int64)
    _, _, _, slot, owner = grams_of(data, off)
    return slot, owner


def variants(text: str, r: np.random.Generator, n: int) -> list[bytes]:
    """A template as it may occur: words missing, more words around, other case."""
    words, out = text.split(), [text.encode()]
    for _ in range(n - 1):
        w = [x for x in words if len(words) < 4 or r.random() > 0.08]
        if r.random() < 0.3:
            w = ["Copyright", str(r.integers(1990, 2026)), *w]
        if r.random() < 0.2:
            w = [*w, "See", "the", "file", "for", "details."]
        t = " ".join(w)
        out.append((t.upper() if r.random() < 0.1 else t.lower() if r.random() < 0.2 else t).encode())
    return out


def train(background: list[bytes], seed: int = 3) -> Classifier:
    """A classifier of TEMPLATES' families against ``background`` lines."""
    r = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    lines: list[bytes] = []
    y: list[int] = []
    for k, f in enumerate(families, 1):
        for t in TEMPLATES[f]:
            v = variants(t, r, 30)
            lines += v
            y += [k] * len(v)
    licence = re.compile(rb"(?i)licen[sc]e|copyright|rights reserved|spdx|creative commons|\bCC BY|\bCC0|general public")
    plain = [x for x in background if x.strip() and not licence.search(x)]
    misses = [v for t in _NEAR_MISSES for v in variants(t, r, 20)]
    for x in plain + misses:
        lines.append(x)
        y.append(0)
    label = np.array(y)
    part = r.random(len(lines)) < 0.25
    part[[i for i in range(len(lines)) if label[i] and lines[i] in {t.encode() for f in families for t in TEMPLATES[f]}]] = False
    model = Classifier(families).fit([x for x, p in zip(lines, part, strict=True) if not p], label[~part])
    model.calibrate([x for x, p in zip(lines, part, strict=True) if p], label[part])
    return model


def agreement(words: list[str], template: list[str]) -> float:
    """Longest common subsequence of words, as a share of the template's words."""
    if not template:
        return 0.0
    row = [0] * (len(template) + 1)
    for w in words:
        last = 0
        for j, t in enumerate(template, 1):
            last, row[j] = row[j], last + 1 if w == t else max(row[j], row[j - 1])
    return row[-1] / len(template)


def best_template(text: str, family: str) -> float:
    words = template_words(text)
    return max(agreement(words, template_words(t)) for t in TEMPLATES[family])


_PARA = ["doc_id", "line", "start_byte", "end_byte", "family", "probability", "similarity", "confirmed", "paragraph"]


def _scan(model):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            data, off = flat(batch.column(1))
            for first, _, d, o in chunks(data, off, 1 << 19):
                row, lo, hi, slot, owner = grams_of(d, o)
                p = net.probabilities(slot, owner, len(lo))
                best = p[:, 1:].argmax(1) + 1
                top = p[np.arange(len(lo)), best]
                named = np.flatnonzero((p.argmax(1) > 0) & (top >= net.least) & (np.bincount(owner, minlength=len(lo)) > 0))
                if not len(named):
                    continue
                raw = d.tobytes()
                nth = named - np.searchsorted(row, row[named])
                texts = [raw[lo[i] : hi[i]].decode("utf-8", "replace") for i in named]
                family = [net.families[best[i]] for i in named]
                close = np.array([best_template(t, f) for t, f in zip(texts, family, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[named] + first)), pa.array(nth), pa.array(lo[named] - o[row[named]]), pa.array(hi[named] - o[row[named]]),
                     pa.array(family), pa.array(np.round(top[named].astype(np.float64), 6)), pa.array(close), pa.array(close >= CLOSE), pa.array(texts)],
                    names=_PARA,
                )

    return run


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence paragraphs of every row of ``docs``.

    Returns doc_id, line (from 0), start_byte, end_byte, family, probability,
    similarity, confirmed and paragraph, a row for each line that the classifier
    names; ``confirmed`` tells whether a template of the family agrees. Null and
    empty texts give none; equal lines and repeated rows are all reported; other
    columns are not read; an empty table gives an empty result. Texts are read
    whole; nothing is shuffled. Background for training is one line of each of
    at most BACKGROUND texts, chosen by hash; without documents the templates
    and near misses alone train. The weights (3.5 MB) are broadcast.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    line = F.expr("element_at(split(text, '\n'), cast(1 + pmod(xxhash64(text), size(split(text, '\n'))) as int))")
    sample = bounded_sample(rows.where("text is not null").select("text", F.lit(1).alias("_one")), "_one", BACKGROUND)
    background = sample.select(F.substring(line, 1, BACKGROUND_CHARS).alias("line")).orderBy("line").collect()
    model = docs.sparkSession.sparkContext.broadcast(train([r["line"].encode() for r in background]))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(tidied(_scan(model)),
        f"doc_id {kind}, line long, start_byte long, end_byte long, family string, probability double, similarity double, confirmed boolean, paragraph string",
    )
