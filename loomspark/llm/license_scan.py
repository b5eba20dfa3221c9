"""Licence scans: a trained paragraph classifier, confirmed against templates.

A paragraph is a line, or a sentence of a line of more than LONG words.  What is judged
is each paragraph, each sentence of a block of lines (lines that follow each other
without an empty one are joined first, so a hard-wrapped notice is whole again) and,
within a sentence of other words, each passage that holds as good as a whole notice.  A
hit belongs to the paragraph in which its notice begins, one for each family; of hits
that overlap, the one whose notice is there more fully counts, and a paragraph's own only
where no sentence has one.

The word 1- to 3-grams (versions, years and addresses normalised) feed a sparse multinomial logistic
regression over the licence families and ``none``.  It is trained here on variants of
the notices below (words dropped, swapped in and wrapped in prose) against prose made of
ordinary words and of the notices' own words shuffled, so that single licence words
prove nothing.  On variants held out of the training the scores are calibrated by a
temperature, and the cutoff under which a paragraph is of unknown family is the lowest
at which at most FALSE_RATE of held-out prose gets a family.  A prediction counts only
if comparison with the family's notices confirms it: enough of the paragraph's word
pairs stand in a notice, a peculiar word among them, and enough of that notice in the paragraph, or the notice as
good as whole within a paragraph that says little else.

A statement of a licence that no family explains is of the family ``unknown``: a lead
(LEADS) with a noun of a licence behind it, where no confirmed hit stands.  The model has
a class for these, trained on statements of made-up licences, and its cutoff is set on
held-out prose as the other one.

The model is trained once, on the driver, and broadcast: its size does not depend on any
table.

A paragraph without a word that is peculiar to the notices cannot be confirmed, so it
is not scored; that changes no result.

Defined cases: a null or empty text has no paragraphs and no licence; repeated rows are
each scanned; whole texts are read; an empty table gives an empty result; extra columns
are not read.  The model does not depend on the table.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

LONG, GRAMS, FALSE_RATE, CONTAINED, COVERED, WHOLE, VARIANTS, STEPS = 40, 3, 0.002, 0.6, 0.5, 0.9, 40, 60
GAP = 8

#: Notices by which licences are commonly stated.
NOTICES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "under the MIT License",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "under the Apache License",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL v3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "under the GNU General Public License",
        "under the GPL version 3",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "under the BSD License",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work has been dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "cc-by-nc-sa": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc-nd": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "isc": [
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "eupl": [
        "Licensed under the European Union Public Licence, version 1.2.",
        "Licensed under the EUPL, Version 1.2",
        "SPDX-License-Identifier: EUPL-1.2",
    ],
    "gfdl": [
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
        "Licensed under the GNU Free Documentation License, version 1.3.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "zlib": [
        "Released under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    ],
    "artistic": [
        "Licensed under the Artistic License 2.0.",
        "it under the terms of the Artistic License",
    ],
    "odbl": [
        "This database is made available under the Open Database License.",
        "Licensed under the Open Data Commons Open Database License.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
    ],
}
#: Statements of a licence whatever its name, which stands at ``*``.
STATEMENTS = (
    "Licensed under the * License", "Released under the * License, version 2.0", "Distributed under the terms of the * licence", "This work is licensed under the * License.",
    "is made available under the * Public License", "subject to the terms and conditions of the * licence agreement", "Licensed under *", "Use of this file is governed by the * licence",
)
UNKNOWN = "unknown"
#: How a statement of a licence begins, and the nouns of which one follows.
LEADS = frozenset({(b"licensed", b"under"), (b"licenced", b"under"), (b"released", b"under"), (b"distributed", b"under"), (b"available", b"under"), (b"published", b"under"), (b"governed", b"by"), (b"terms", b"of"), (b"conditions", b"of")})
NOUNS = frozenset({b"license", b"licence", b"licenses", b"licences", b"eula"})
#: Ordinary words that notices also use.
COMMON = frozenset(
    "a all and any are as at be by can charge code copy extent file following form forms free from general has in into is it later library may met "
    "no not of on or other part person portions prior program public published publisher related released rights shall source subject terms that "
    "the these this to under use v version with without work written you your law author authors possible included example above accompanying agreed "
    "applicable any appear arising available basis conditions copies damages data database document documentation either event express fee held hereby "
    "implied kind liable made may name names neither nor notice obtain open or permission program programs promote products provided purpose required "
    "software specific terms their this unless used warranties warranty will writing boost standard union european "
    "nc nd sa".split()
)
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_NUMBER = re.compile(rb"v?\d+")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")
_END = re.compile(r"[.!?;]\s*$")


def words(text: str) -> list[bytes]:
    """Lower-case words; runs of numbers (versions, years) become one ``#``."""
    out: list[bytes] = []
    for w in text.encode("utf-8", "surrogatepass").translate(_TABLE).split():
        w = b"#" if _NUMBER.fullmatch(w) else w
        if not (w == b"#" and out and out[-1] == b"#"):
            out.append(w)
    return out


def grams(w: list[bytes]) -> list[tuple[bytes, ...]]:
    return [tuple(w[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(w) - n + 1)]


def _pairs(w: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip([b"^", *w], [*w, b"$"], strict=True))


class Scanner:
    """The trained model, its calibration and the templates."""

    def __init__(self, seed: int = 5):
        rng = random.Random(seed)
        named = sorted(NOTICES)
        self.families = [*named, UNKNOWN]
        self.templates = {f: [_pairs(words(t)) for t in NOTICES[f]] for f in named}
        self.peculiar = ({w for f in named for t in NOTICES[f] for w in words(t)} | NOUNS | {x for x, _ in LEADS}) - {w.encode() for w in COMMON} - {b"#"}
        self.inner = [{p for p in t if b"^" not in p and b"$" not in p} for ts in self.templates.values() for t in ts]
        whose = [f for f in named for _ in self.templates[f]]
        self.of = {f: [k for k, g in enumerate(whose) if g == f] for f in named}
        self.pairs = {p for ts in self.templates.values() for t in ts for p in t} | LEADS
        rows = self._variants(rng)
        held = [r for k, r in enumerate(rows) if k % 4 == 0]
        fitted = [r for k, r in enumerate(rows) if k % 4]
        self.index: dict[tuple[bytes, ...], int] = {}
        seen = Counter(g for w, _ in fitted for g in grams(w))
        for g in sorted(g for g, n in seen.items() if n > 1):
            self.index[g] = len(self.index)
        self._train(fitted)
        self._calibrate(held)

    def _variants(self, rng: random.Random) -> list[tuple[list[bytes], int]]:
        """(words, class) of notices and of prose; the last class is ``none``."""
        common, letters = sorted(w.encode() for w in COMMON), "abcdefghijklmnopqrstuvwxyz"
        made = lambda: "".join(rng.choices(letters, k=rng.randrange(2, 9))).encode()
        prose = lambda n: [rng.choice(common) if rng.random() < 0.6 else made() for _ in range(n)]
        rows = []
        for k, f in enumerate(self.families):
            for t in NOTICES.get(f) or STATEMENTS * 3:
                w = words(t)
                for _ in range(VARIANTS):
                    v = [x for x in w if len(w) < 5 or rng.random() > 0.06]
                    if f == UNKNOWN:
                        name = [made() for _ in range(rng.randrange(1, 4))]
                        v = [x for part in re.split(r"(\*)", t) for x in (name if part == "*" else words(part))]
                    if rng.random() < 0.5:
                        cut = rng.randrange(0, 7)
                        v = prose(rng.randrange(0, 1 + cut)) + v + prose(rng.randrange(0, 7))
                    rows.append((v, k))
        none, every = len(self.families), [w for ts in NOTICES.values() for t in ts for w in words(t)]
        for _ in range(len(rows)):
            v = prose(rng.randrange(1, 30))
            if rng.random() < 0.5:
                v += rng.sample(every, rng.randrange(1, 8))
                rng.shuffle(v)
            rows.append((v, none))
        rng.shuffle(rows)
        return rows

    def _row(self, w: list[bytes]) -> list[int]:
        return [i for g in grams(w) if (i := self.index.get(g)) is not None]

    def _train(self, rows: list[tuple[list[bytes], int]]) -> None:
        classes = len(self.families) + 1
        at = [np.array(self._row(w), np.int64) for w, _ in rows]
        whose = np.repeat(np.arange(len(rows)), [len(a) for a in at])
        flat, gold = np.concatenate(at), np.eye(classes)[[y for _, y in rows]]
        scale = 1 / np.sqrt(np.bincount(whose, minlength=len(rows)).clip(1))
        weights, bias = np.zeros((len(self.index), classes)), np.zeros(classes)
        seen, seen_b = np.full(weights.shape, 1e-8), np.full(classes, 1e-8)
        for _ in range(STEPS):
            z = np.stack([np.bincount(whose, weights[flat, c], len(rows)) for c in range(classes)], 1) * scale[:, None] + bias
            p = np.exp(z - z.max(1, keepdims=True))
            d = (gold - p / p.sum(1, keepdims=True)) / len(rows)
            back = (d * scale[:, None])[whose]
            grad = np.stack([np.bincount(flat, back[:, c], len(self.index)) for c in range(classes)], 1) - 1e-6 * weights
            seen, seen_b = seen + grad * grad, seen_b + d.sum(0) ** 2
            weights, bias = weights + 0.3 * grad / np.sqrt(seen), bias + 0.3 * d.sum(0) / np.sqrt(seen_b)
        self.weights, self.bias = weights, bias

    def logits(self, w: list[bytes]) -> np.ndarray:
        at = self._row(w)
        return self.weights[at].sum(0) / np.sqrt(max(1, len(at))) + self.bias if at else self.bias.copy()

    def _calibrate(self, rows: list[tuple[list[bytes], int]]) -> None:
        z, y = np.array([self.logits(w) for w, _ in rows]), np.array([k for _, k in rows])

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

        self.temperature = min(np.geomspace(0.2, 5, 60), key=loss)
        p = self._softmax(z)
        none = p[y == len(self.families)]
        least = lambda x: float(np.sort(x)[min(len(x) - 1, int(np.ceil((1 - FALSE_RATE) * len(x))))])
        self.cutoff, self.unknown_cutoff = max(0.5, least(none[:, :-2].max(1))), max(0.5, least(none[:, :-1].sum(1)))

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        e = np.exp((z - z.max(-1, keepdims=True)) / self.temperature)
        return e / e.sum(-1, keepdims=True)

    def _possible(self, w: list[bytes]) -> bool:
        """Whether a notice could be confirmed: a peculiar word and a word pair of one."""
        return not self.peculiar.isdisjoint(w) and not self.pairs.isdisjoint(zip(w, w[1:], strict=False))

    def classify(self, w: list[bytes]) -> tuple[str | None, float, float]:
        """(family or None, probability, share of the paragraph found in the best notice)."""
        p = self._softmax(self.logits(w))[:-2]
        k = int(p.argmax())
        mine, match, confirmed, possible = _pairs(w), 0.0, False, self._possible(w)
        for t in self.templates[self.families[k]]:
            both, inner = len(mine & t), [x for x in t if b"^" not in x and b"$" not in x]
            alike = both / len(mine)
            match = max(match, alike)
            whole = sum(x in mine for x in inner) >= WHOLE * len(inner)
            confirmed |= both >= COVERED * len(t) and alike >= CONTAINED or whole and alike >= CONTAINED / 2
        return (self.families[k] if confirmed and possible and p[k] >= self.cutoff else None), float(p[k]), match

    def statements(self, w: list[bytes]) -> list[tuple[int, int, float]]:
        """[from, to) of the statements of a licence, whatever its name, and the probability that they are of any."""
        out = []
        for i in [i for i, x in enumerate(zip(w, w[1:], strict=False)) if x in LEADS]:
            noun = next((j for j in range(i + 2, min(len(w), i + 2 + GAP)) if w[j] in NOUNS), i + 1 if w[i][:5] == b"licen" else 0)
            if noun:
                end = max(noun + 1, min(len(w), i + 5))
                p = float(self._softmax(self.logits(w[i:end]))[:-1].sum())
                if p >= self.unknown_cutoff:
                    out.append((i, end, p))
        return out

    def _passages(self, w: list[bytes]) -> set[tuple[int, int]]:
        """[from, to) of the passages that hold WHOLE of a notice's word pairs, none GAP words from the next."""
        pairs, out = list(zip(w, w[1:], strict=False)), set()
        known = self.pairs.intersection(pairs)
        for t in self.inner:
            need = WHOLE * len(t)
            if len(known & t) < need:
                continue
            at = [i for i, x in enumerate(pairs) if x in t]
            edges = [0, *(k for k in range(1, len(at)) if at[k] - at[k - 1] > GAP), len(at)]
            for a, b in zip(edges, edges[1:], strict=False):
                count = Counter(pairs[i] for i in at[a:b])
                if len(count) < need:
                    continue
                while b - a > 1 and count[pairs[at[a]]] > 1 and at[a + 1] > at[a] + 1:  # a pair that the notice has again
                    count[pairs[at[a]]] -= 1
                    a += 1
                while b - a > 1 and count[pairs[at[b - 1]]] > 1 and at[b - 2] < at[b - 1] - 1:
                    count[pairs[at[b - 1]]] -= 1
                    b -= 1
                out.add((at[a], at[b - 1] + 2))
        return out

    def _found(self, w: list[bytes], a: int, b: int) -> tuple | None:
        """(share of the notice found, its first and last word, family, probability, match) of words [a, b)."""
        family, p, match = self.classify(w[a:b])
        if not family:
            return None
        pairs = list(zip(w[a:b], w[a + 1 : b], strict=False))
        shares = [(len(t.intersection(pairs)) / len(t), t) for t in (self.inner[k] for k in self.of[family])]
        share, best = max(shares, key=lambda x: x[0])
        at = [a + i for i, x in enumerate(pairs) if x in best] or [a, b - 1]
        return share, at[0], at[-1] + 1, family, p, match

    def _block(self, block: list[tuple[int, str]]) -> list[tuple[int, str, float, float]]:
        """Hits of a block of paragraphs (number, text)."""
        w: list[bytes] = []
        owner: list[int] = []
        cuts, starts = {0}, []
        for k, text in block:
            starts.append(len(w))
            for j, part in enumerate(_SENTENCE.split(text)):
                if j:
                    cuts.add(len(w))
                w += words(part)
            if _END.search(text):
                cuts.add(len(w))
            owner += [k] * (len(w) - len(owner))
        if self.peculiar.isdisjoint(w):
            return []
        ends = sorted(cuts | {len(w)})
        said, alone, other = [], [], []
        for a, b in zip(ends, ends[1:], strict=False):
            if self._possible(w[a:b]):
                said += [self._found(w, a, b), *(self._found(w, a + c, a + d) for c, d in self._passages(w[a:b]))]
                other += [(0.0, a + c, a + d, UNKNOWN, p, 0.0) for c, d, p in self.statements(w[a:b])]
        for a, b in zip(starts, [*starts[1:], len(w)], strict=True):
            if self._possible(w[a:b]):
                alone.append(self._found(w, a, b))
        kept: list[tuple] = []
        for each in (said, alone, other):  # of two that overlap, the one whose notice is there more fully
            for x in sorted(filter(None, each), key=lambda x: (-x[0], x[1] - x[2], x[1], -x[4])):
                if all(x[2] < y[1] or y[2] < x[1] for y in kept):
                    kept.append(x)
        hits: dict[tuple[int, str], tuple[float, float]] = {}
        for _, a, _, family, p, match in kept:
            hits[owner[a], family] = max(hits.get((owner[a], family), (0.0, 0.0)), (p, match))
        return [(k, family, p, match) for (k, family), (p, match) in sorted(hits.items())]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str, float, float]]]:
        """Paragraphs of a text, and (number, family, probability, match) of those with a licence."""
        lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
        if not lines:
            return 0, []
        if self.peculiar.isdisjoint(text.encode("utf-8", "surrogatepass").translate(_TABLE).split()):
            return sum(len(_SENTENCE.split(x)) if x.count(" ") >= LONG else 1 for x in lines), []
        n, found, block = 0, [], []
        for line in [*text.split("\n"), ""]:
            if not words(line):  # an empty line, or one of signs alone, ends a block
                found += self._block(block)
                block = []
                n += bool(line) and not line.isspace() and len(_SENTENCE.split(line) if line.count(" ") >= LONG else (line,))
                continue
            for part in _SENTENCE.split(line) if line.count(" ") >= LONG else (line,):
                block.append((n, part))
                n += 1
        return n, found


@functools.cache
def scanner() -> Scanner:
    return Scanner()


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, families, hits of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(scanner())

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sent.value.scan(x.as_py()) for x in batch.column(1)]
        hits = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("match", pa.float64())]))
        names = ["paragraph", "family", "probability", "match"]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len({x[0] for x in f}) for _, f in found], pa.int64()),
                pa.array([",".join(sorted({x[1] for x in f})) for _, f in found]),
                pa.array([[dict(zip(names, x, strict=True)) for x in f] for _, f in found], hits),
            ],
            ["doc_id", "n_paragraphs", "n_licensed", "families", "hits"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        docs.select("doc_id", "text"),
        scan,
        f"doc_id {kind}, n_paragraphs long, n_licensed long, families string, "
        "hits array<struct<paragraph:int,family:string,probability:double,match:double>>",
    )
