"""Licence scans by a trained paragraph classifier (operator 3).

Paragraphs are the lines of a text, runs of lines between blank ones, and whole blocks of lines between
blank ones. Of the runs all are taken that have at most RUN lines, or whose lines between the first and the last have at most WITHIN words: so any
template lies, however it is wrapped, in a run of just the lines that it touches. Each is scored: word n-grams (one to three words, ASCII
punctuation being blank) are hashed into DIM places, and a softmax regression over the families below
and an `unknown` class adds up their weights, by running sums over the words of a text. It is trained
with numpy on variations of the templates (words dropped, other words around them) and, for
`unknown`, on the NEGATIVES different lines of the corpus with the smallest hashes, some of them with the lines
after them, and on shuffled templates; what shares CONFIRM of a template is left out. A family is
predicted if its probability is at least the limit that keeps all but one in a thousand of the
paragraphs unknown that begin at every fifth of those lines, which are not trained on, and confirmed if at least CONFIRM of the template's word trigrams
are shared; what is not confirmed is unknown. Of paragraphs with lines in common the one with the larger share stays, then the shorter.

Edge cases: null and empty texts, and texts without a match, have no licence; paragraphs of any
length are whole; repeated rows are scanned each; empty tables give empty results; other columns
than the id are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import vec

#: Characteristic sentences of public licences.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The software is provided \"as is\", without warranty of any kind, express or implied", "Released under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties are disclaimed", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "Licensed under the GNU General Public License version 3.", "Distributed under GPLv3 or later", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"],
    "agpl": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "Licensed under the GNU Affero General Public License version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "zlib": ["In no event will the authors be held liable for any damages arising from the use of this software.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "SPDX-License-Identifier: Zlib"],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "CC0 1.0 Universal Public Domain Dedication", "SPDX-License-Identifier: CC0-1.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "proprietary": ["All rights reserved.", "All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Proprietary and confidential. All rights reserved."],
}
FAMILIES = [*TEMPLATES, "unknown"]
DIM, NEGATIVES, CONFIRM, RUN = 1 << 15, 20_000, 0.5, 4
BATCH, EPOCHS, STEPS = 1000, 4, 60
#: As many words as the longest template has.
WITHIN = max(len(re.findall(r"[^\W_]+", t)) for ts in TEMPLATES.values() for t in ts)
TOKEN = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
BLANK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def grams(block: vec.Texts) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Starts of the words of a block, and for one to three words the place of each n-gram and its first word."""
    inside = np.concatenate(([False], ~BLANK[block.data], [False]))
    cut = np.zeros(len(block.data) + 1, bool)
    cut[block.offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    hashes, first = block.hashes(starts, ends, lower=True), np.searchsorted(starts, block.offsets)
    found = [vec.windows(hashes, first, k) for k in (1, 2, 3)]
    return starts, [((h % np.uint64(DIM)).astype(np.int64), at) for h, at in found]


def places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of the text and the place of each n-gram."""
    rows, columns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for block in vec.texts(pa.array(texts, pa.string())):
        starts, found = grams(block)
        for place, at in found:
            rows.append(block.first + block.doc_of(starts[at]))
            columns.append(place)
    return np.concatenate(rows), np.concatenate(columns)


def paragraphs(block: vec.Texts, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Number of the text, number of the line in it, number of lines, first and last byte of each paragraph."""
    starts, ends, first = block.lines()
    doc = np.repeat(np.arange(block.n), np.diff(first))
    full = np.searchsorted(words, ends) > np.searchsorted(words, starts)
    opens = full & np.concatenate(([True], ~full[:-1] | (doc[1:] != doc[:-1])))
    head = np.flatnonzero(opens)
    closes = np.flatnonzero(full & np.concatenate((~full[1:] | (doc[1:] != doc[:-1]), [True])))
    last = np.zeros(len(starts), np.int64)
    last[full] = np.repeat(closes, closes - head + 1)
    before = np.searchsorted(words, starts)  # words before each line
    some, m, at, n = np.flatnonzero(full), 1, [], []
    while len(some):  # a line of a block has a word or more, so runs are at most WITHIN + 2 lines long
        at.append(some)
        n.append(np.full(len(some), m))
        m += 1
        some = some[some + m - 1 <= last[some]]
        if m > RUN:
            some = some[before[some + m - 1] - before[some + 1] <= WITHIN]
    at.append(head)
    n.append(closes - head + 1)
    at, n = np.concatenate(at), np.concatenate(n)
    _, once = np.unique(at * (len(starts) + 1) + n, return_index=True)
    at, n = at[once], n[once]
    return doc[at], at - first[doc[at]], n, starts[at], ends[at + n - 1]


class Classifier:
    def __init__(self, negatives: list[list[str]], seed: int = 5):
        self.shapes = {f: [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for w in map(tokens, ts)] for f, ts in TEMPLATES.items()}
        # licences are none: runs end before them
        clean = lambda lines: self.share("\n".join(lines), [*TEMPLATES]) < CONFIRM
        negatives = [run if clean(run) else run[:1] for run in negatives if clean(run[:1])]
        rng = np.random.default_rng(seed)
        filler = [w for t in negatives[:500] for w in tokens(t[0])] or ["lorem", "ipsum", "dolor"]
        xs, ys = [], []
        for y, family in enumerate(TEMPLATES):
            for template in TEMPLATES[family]:
                words = tokens(template)
                xs.append(template)
                ys.append(y)
                for _ in range(40):
                    own = [w for w in words if rng.random() > 0.1]
                    around = rng.choice(filler, int(rng.integers(0, 12))).tolist()
                    cut = int(rng.integers(0, len(around) + 1))
                    xs.append(" ".join([*around[:cut], *own, *around[cut:]]))
                    ys.append(y)
                for _ in range(10 if len(words) > 5 else 0):
                    xs.append(" ".join(rng.permutation(words).tolist()[: max(2, len(words) // 3)]))
                    ys.append(len(TEMPLATES))
        # every fifth is never trained on and calibrates the limit
        held = sorted({"\n".join(run[:m]) for run in negatives[::5] for m in range(1, len(run) + 1)})
        xs += ["\n".join(run[: (1, 1, 1, 2, 1, 1, 1, RUN)[i % 8]]) for i, run in enumerate(negatives) if i % 5]
        ys += [len(TEMPLATES)] * (len(xs) - len(ys))
        rows, columns = places(xs)
        size = np.bincount(rows, minlength=len(xs))
        y = np.eye(len(FAMILIES), dtype=np.float32)[ys]
        balance = (1 / np.maximum(y.sum(0), 1))[ys]
        balance *= len(xs) / balance.sum()
        scale = (1 / np.sqrt(np.maximum(size, 1))).astype(np.float32)
        # batches of about BATCH paragraphs, drawn once
        batch_of = rng.permutation(len(xs)) % max(1, len(xs) // BATCH)
        order = np.lexsort((columns, rows, batch_of[rows]))
        rows, columns = rows[order], columns[order]
        ends = np.searchsorted(batch_of[rows], np.arange(batch_of.max() + 2))
        w, self.b, seen = np.zeros((DIM, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32), np.full((DIM, len(FAMILIES)), 1e-6, np.float32)
        for k in [*range(len(ends) - 1)] * max(EPOCHS, -(-STEPS // (len(ends) - 1))):
            of, at = rows[ends[k] : ends[k + 1]], columns[ends[k] : ends[k + 1]]
            some, begin, own = np.unique(of, return_index=True, return_inverse=True)
            z = np.add.reduceat(w[at], begin) * scale[some, None] + self.b
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - y[some]) * (balance[some, None] / len(some)).astype(np.float32)
            by_place = np.argsort(at, kind="stable")
            used, cuts = np.unique(at[by_place], return_index=True)
            grad = np.add.reduceat((g * scale[some, None])[own[by_place]], cuts) + 1e-6 * w[used]
            seen[used] += grad**2
            w[used] -= 0.5 * grad / np.sqrt(seen[used])
            self.b -= 0.5 * g.sum(0)
        self.w = w
        self.limit = 0.5
        if held:
            highest = np.quantile(self.probabilities(held)[:, :-1].max(1), 0.999, method="higher")
            self.limit = float(max(0.5, np.nextafter(highest, 2)))

    def probabilities(self, texts: list[str]) -> np.ndarray:
        rows, columns = places(texts)
        n = np.maximum(np.bincount(rows, minlength=len(texts)), 1)
        z = np.stack([np.bincount(rows, self.w[columns, c], len(texts)) for c in range(len(FAMILIES))], 1) / np.sqrt(n)[:, None] + self.b
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def share(self, paragraph: str, families: list[str]) -> float:
        """The largest share of a template's trigrams."""
        words = tokens(paragraph)
        own = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
        return max(len(own & t) / len(t) for f in families for t in self.shapes[f])

    def __call__(self, block: vec.Texts) -> Iterator[tuple[int, int, str, float, float]]:
        """text, line, family, probability, share of a template's trigrams of each licence."""
        words, found = grams(block)
        sums = []
        for place, at in found:
            total = np.zeros((len(words) + 1, len(FAMILIES)))
            total[at + 1] = self.w[place]
            sums.append(np.cumsum(total, axis=0, out=total))
        doc, line, n, lo, hi = paragraphs(block, words)
        a, b = np.searchsorted(words, lo), np.searchsorted(words, hi)
        z, count = np.zeros((len(a), len(FAMILIES))), np.zeros(len(a), np.int64)
        for k, total in enumerate(sums):
            end = np.maximum(b - k, a)
            z += total[end] - total[a]
            count += end - a
        z = z / np.sqrt(np.maximum(count, 1))[:, None] + self.b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p[:, :-1].argmax(1)
        top = p[np.arange(len(p)), best]
        some = []
        for i in np.flatnonzero((top >= self.limit) & (top >= p[:, -1])).tolist():
            share = self.share(block.data[lo[i] : hi[i]].tobytes().decode("utf-8", "replace"), [FAMILIES[best[i]]])
            if share < CONFIRM and b[i] - a[i] < 3:
                continue
            some.append((int(doc[i]), -share, int(n[i]), -float(top[i]), int(line[i]), FAMILIES[best[i]]))
        taken: set[tuple[int, int]] = set()
        for d, share, m, prob, no, family in sorted(some):
            lines = {(d, no + j) for j in range(m)}
            if not lines & taken:
                taken |= lines
                yield d, no, family, -prob, -share


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", negatives: int = NEGATIVES) -> Classifier:
    some = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")
    hashes = docs.select(F.explode(F.transform(some, lambda x: F.xxhash64(F.lit(3), x))).alias("h")).distinct()
    top = hashes.orderBy("h").limit(negatives).agg(F.max("h")).first()[0]
    if top is None:
        return Classifier([])
    lines = docs.select(F.split(text, "\n", -1).alias("lines"))
    runs = F.transform("lines", lambda x, i: F.struct(F.xxhash64(F.lit(3), x).alias("h"), F.slice("lines", i + 1, RUN).alias("run")))
    picked = lines.select(F.explode(F.filter(runs, lambda r: (r["h"] <= top) & (F.trim(r["run"][0]) != ""))).alias("r"))
    picked = picked.groupBy("r.h").agg(F.min("r.run").alias("run")).orderBy("h").collect()
    return Classifier([[*itertools.takewhile(str.strip, r.run)] or r.run[:1] for r in picked])


def scan(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text", unconfirmed: bool = False) -> DataFrame:
    """A row for each paragraph with a licence: id, line_no (of its first line), family, probability, template_share, confirmed.

    A prediction that no template confirms is unknown, and given only if it is asked for.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = shared.value
        for batch in batches:
            out = []
            for block in vec.texts(batch.column(1), 1 << 20):
                for i, no, family, p, share in classify(block):
                    if unconfirmed or share >= CONFIRM:
                        out.append((batch.column(0)[block.first + i].as_py(), no, family, p, share, share >= CONFIRM))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "line_no", "family", "probability", "template_share", "confirmed"])

    return docs.select(doc_id, text).mapInArrow(run, f"id {kind}, line_no int, family string, probability double, template_share double, confirmed boolean").withColumnRenamed("id", doc_id)
