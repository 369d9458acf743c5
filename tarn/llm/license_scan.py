"""Licence scans: a trained paragraph classifier, confirmed against templates.

A paragraph is a run of lines without one between them that has no word (marks
of comments are no words).  Statements are found first: the runs of words in a
paragraph, wrapped over lines or not, that hold ``cover`` or more of the word
pairs of a template.  The words that no statement takes are then judged by lines
and, what is left, by paragraphs, in windows of ``window`` words that overlap by
half.

Word 1- to 3-grams that occur in the training statements are the sparse features
of a multinomial logistic regression over the licence families and an unknown
class, which also learns from statements of licences beyond the families.  Its
probabilities are calibrated by a temperature fitted on statements, foreign
licences and look-alikes of which training for that fit saw nothing.  A unit
names the families of probability ``low`` or more, and above that of the unknown
class, if all families together have ``least`` or more.  A statement counts if
the unit of its own words names its family; its finding is confirmed.

A family also needs the words that tell licences apart: those of its template
that are names or versions must be there, and no word that makes another licence
of the name ("Lesser", "Affero") may be, unless another family in the unit has it.

Negatives are windows of the corpus: a bounded sample of ``negatives`` of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import col
from .textvec import Words, find_words, mix, words_of

UNKNOWN = "unknown"

#: Statements by which works name their licence, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "BSD-3-Clause": (
        "Released under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0-1.0": (
        "Released into the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.",
    ),
}

#: Sentences of like words that name no licence.
LOOKALIKES = (
    "The driver must carry a license at all times.",
    "She was granted permission to use the library after work.",
    "The general public may visit the source of the river, free of charge.",
    "The terms of the treaty were published in version 2 of the report.",
    "Human rights are reserved for all.",
    "Apache helicopters were shown to the public.",
    "MIT is a university in Cambridge.",
    "The software is licensed to the following persons.",
    "Creative work is common in this school.",
)


#: Licences beyond the families, by name and identifier; statements of them are of the unknown class.
FOREIGN = (
    ("GNU Lesser General Public License, version 2.1", "LGPL-2.1-only"),
    ("GNU Affero General Public License, version 3", "AGPL-3.0-only"),
    ("GNU Free Documentation License, version 1.3", "GFDL-1.3-only"),
    ("Artistic License 2.0", "Artistic-2.0"),
    ("Eclipse Public License 2.0", "EPL-2.0"),
    ("Common Development and Distribution License, version 1.1", "CDDL-1.1"),
    ("Boost Software License, Version 1.0", "BSL-1.0"),
    ("European Union Public Licence, version 1.2", "EUPL-1.2"),
    ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"),
    ("Creative Commons Attribution 3.0 Unported License", "CC-BY-3.0"),
    ("Apache License, Version 1.1", "Apache-1.1"),
    ("Mozilla Public License, Version 1.1", "MPL-1.1"),
    ("2-Clause BSD License", "BSD-2-Clause"),
    ("SIL Open Font License, Version 1.1", "OFL-1.1"),
    ("Microsoft Public License", "MS-PL"),
    ("zlib License", "Zlib"),
    ("PostgreSQL License", "PostgreSQL"),
    ("Open Database License, version 1.0", "ODbL-1.0"),
)
FOREIGN_FORMS = ("This work is licensed under the {0}.", "Released under the {0}.", "SPDX-License-Identifier: {1}")

#: Words that tell licences apart, by name or version: a finding needs those of its template.
NAMING = "mit apache gnu gpl lgpl agpl lesser affero bsd clause mozilla mpl isc cc cc0 creative commons by sa nc attribution sharealike noncommercial 0 1 2 3 4".split()
#: Of them, and beyond, those that make another licence of a name.
MODIFIERS = "clause lesser library affero lgpl agpl sa nc nd sharealike noncommercial noderivatives noncommercialsharealike".split()


@dataclass(frozen=True)
class LicenseScan:
    negatives: int = 2000
    window: int = 48
    least: float = 0.5
    low: float = 0.2
    cover: float = 0.6
    copies: int = 60
    steps: int = 400
    seed: int = 3


_G = mix(np.arange(101, 105, dtype=np.uint64)) | np.uint64(1)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words."""
    value = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for j in range(k if len(value) else 0):
        value = value + h[j : len(h) - k + 1 + j] * _G[j]
    return mix(value)


def words_hash(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return find_words(data, np.array([0, len(data)])).hash


@dataclass
class Classifier:
    families: list[str]
    vocabulary: np.ndarray  # sorted hashes of n-grams
    weights: np.ndarray  # n-grams x classes, the last class is unknown
    bias: np.ndarray
    temperature: float
    templates: list[tuple[str, str, np.ndarray]]  # family, text, hashes of word pairs (or single words)
    params: LicenseScan

    def __post_init__(self) -> None:
        self.table = np.zeros(1 << 18, bool)
        self.table[self.vocabulary >> np.uint64(46)] = True
        self.length = [len(words_hash(text)) for _, text, _ in self.templates]
        # the family whose templates alone hold an n-gram, or -1
        held = np.zeros((len(self.families), len(self.vocabulary)), bool)
        for f, text, _ in self.templates:
            for k in (1, 2, 3):
                held[self.families.index(f)] |= np.isin(self.vocabulary, grams(words_hash(text), k))
        self.only = np.where(held.sum(0) == 1, held.argmax(0), -1)
        naming, own = words_hash(" ".join(NAMING)), [words_hash(text) for _, text, _ in self.templates]
        self.naming = [np.unique(h[np.isin(h, naming)]) for h in own]
        self.modifiers = [np.setdiff1d(words_hash(" ".join(MODIFIERS)), h) for h in own]
        self.digits = words_hash("1 2 3 4 5 6 7 8 9")
        self.ends = [h[-1] for h in own]
        self.pair_of = [np.isin(self.vocabulary, pairs) for _, _, pairs in self.templates]

    def known_of(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Position and feature of every known run of k words."""
        g = grams(h, k)
        some = np.flatnonzero(self.table[g >> np.uint64(46)])
        place = np.minimum(np.searchsorted(self.vocabulary, g[some]), len(self.vocabulary) - 1)
        hit = self.vocabulary[place] == g[some]
        return some[hit], place[hit]

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and feature of every known n-gram in a word sequence."""
        at, which = zip(*(self.known_of(h, k) for k in (1, 2, 3)))
        return np.concatenate(at), np.concatenate(which)

    def features(self, h: np.ndarray) -> np.ndarray:
        x = np.zeros(len(self.vocabulary))
        np.add.at(x, self.known(h)[1], 1)
        return x / np.sqrt(max(1, len(h)))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights + self.bias) / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)

    def judge(self, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the units ``h[first:last]``; one without known words is of the unknown class."""
        z, some = np.zeros((len(first), self.weights.shape[1])), np.zeros(len(first), bool)
        for k in (1, 2, 3):
            at, which = self.known_of(h, k)
            lo = np.searchsorted(at, first)
            n = np.maximum(np.searchsorted(at, last - k, side="right") - lo, 0)
            for a in range(0, len(n), 2048):
                have = np.flatnonzero(n[a : a + 2048]) + a
                if len(have):
                    begin = np.cumsum(n[have]) - n[have]
                    rows = np.arange(n[have].sum()) + np.repeat(lo[have] - begin, n[have])
                    z[have] += np.add.reduceat(self.weights[which[rows]], begin)
                    some[have] = True
        z = (z / np.sqrt(np.maximum(1, last - first))[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True, initial=0.0))
        z /= z.sum(-1, keepdims=True)
        z[~some] = np.eye(z.shape[1])[-1]
        return z

    def consistent(self, h: np.ndarray, t: int, a: int, b: int, other: np.ndarray) -> bool:
        """Whether the words a to b tell that licence of all others by which the template ``t`` names; words where ``other`` are another's."""
        own = h[a:b]
        if not np.isin(self.naming[t], own).all() or np.isin(own[~other[a:b]], self.modifiers[t]).any():
            return False
        # a version that goes on: 2.1 is not 2
        return not (b < len(h) and own[-1] == self.ends[t] and own[-1] in self.digits and h[b] in self.digits and not other[b])

    def plausible(self, h: np.ndarray, families: list[int]) -> list[int]:
        """Those of the families that the unit's telling words allow."""
        pairs = grams(h, 2)

        def told(t: int) -> bool:
            """By the template's names, or if it has none, by half of the word pairs that confirm it."""
            return bool(np.isin(self.naming[t], h).all()) if len(self.naming[t]) else float(np.isin(self.templates[t][2], pairs).mean()) >= self.params.cover / 2

        able = [[t for t, (f, _, _) in enumerate(self.templates) if f == self.families[k] and told(t)] for k in families]
        strange = [m for m in words_hash(" ".join(MODIFIERS)) if m in h]
        strange = [m for m in strange if not any(m in self.naming[t] for own in able for t in own)]
        return [k for k, own in zip(families, able) if any(not np.isin(strange, self.modifiers[t]).any() for t in own)]

    def families_of(self, p: np.ndarray) -> list[int]:
        """The families that a unit of these probabilities names.

        Those of probability ``low`` or more, and above that of the unknown
        class, where the families together have ``least`` or more: a unit may
        name two licences, of which neither has ``least`` alone.
        """
        if 1 - p[-1] < self.params.least:
            return []
        return [int(f) for f in np.flatnonzero((p[:-1] >= self.params.low) & (p[:-1] > p[-1]))]

    def named(self, h: np.ndarray) -> list[tuple[int, float]]:
        """Families that a unit names, each with its probability.

        One family can outweigh the others, so the words that only its templates
        hold are left out and the rest is judged again, until it names no other
        family of which it has such words.
        """
        out: dict[int, float] = {}
        while len(h):
            p = self.judge(h, np.array([0]), np.array([len(h)]))[0]
            hits = [(k, *self.known_of(h, k)) for k in (1, 2, 3)]
            new = [f for f in self.plausible(h, self.families_of(p)) if f not in out and (not out or any((self.only[which] == f).any() for _, _, which in hits))]
            if not new:
                break
            out |= {f: float(p[f]) for f in new}
            keep = np.ones(len(h), bool)
            for k, at, which in hits:
                for j in range(k):
                    keep[at[np.isin(self.only[which], new)] + j] = False
            if keep.all():
                break
            h = h[keep]
        return list(out.items())

    def best_template(self, h: np.ndarray, family: int) -> tuple[str, float, bool]:
        """The template of the family that the unit covers most, how much of it, and whether it confirms the family."""
        pairs, none = np.unique(grams(h, 2 if len(h) > 1 else 1)), np.zeros(len(h), bool)
        cover, text, t = max((float(np.isin(own, pairs).mean()), text, t) for t, (f, text, own) in enumerate(self.templates) if f == self.families[family])
        return text, cover, cover >= self.params.cover and self.consistent(h, t, 0, len(h), none)

    def statements(self, h: np.ndarray, paragraph: np.ndarray) -> list[tuple[int, int, int, float, float]]:
        """Template, first and last word (exclusive), probability and cover of each statement.

        A statement is a shortest run of words of a paragraph, at most half longer
        than a template (four words at least), with the most different word pairs
        of it, ``cover`` of them or more.  Of those that share more than half
        of their pairs the one with the most pairs counts; the others only where
        they hold the whole template of another family and a pair of their own.
        """
        at, which = self.known_of(h, 2)
        inside = paragraph[at] == paragraph[np.minimum(at + 1, len(h) - 1)]
        at, which = at[inside], which[inside]
        found = []
        for t, (_, text, pairs) in enumerate(self.templates):
            mine = self.pair_of[t][which]
            need = max(1, int(np.ceil(self.params.cover * len(pairs) - 1e-9)))
            if mine.sum() < need:
                continue
            pos, pair = at[mine], which[mine]
            reach = self.length[t] + max(4, self.length[t] // 2) - 2
            key = pos + paragraph[pos] * (reach + 1)  # far apart in different paragraphs
            near = np.flatnonzero(key[need - 1 :] - key[: len(key) - need + 1] <= reach)
            if not len(near):
                continue
            end = np.searchsorted(key, key[near] + reach, side="right")
            fresh = np.concatenate(([True], near[1:] >= np.maximum.accumulate(end)[:-1]))
            ends = np.maximum.accumulate(end)[np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(near) - 1]))]
            for a, b in zip(near[fresh].tolist(), ends.tolist()):
                found += [(t, len(pairs), hit) for hit in _densest(key[a:b].tolist(), pos[a:b].tolist(), pair[a:b].tolist(), need, reach)]
        if not found:
            return []
        first, last = np.array([hit[0] for *_, hit in found]), np.array([hit[-1] + 2 for *_, hit in found])
        p = self.judge(h, first, last)
        out, claimed = [], {}
        # words of statements that are whole, by family: they are not held against another licence beside them
        whole = {f: np.zeros(len(h), bool) for f in range(len(self.families))}
        for t, m, hit in found:
            if len(hit) == m:
                for x in hit:
                    whole[self.families.index(self.templates[t][0])][x : x + 2] = True
        order = sorted(range(len(found)), key=lambda i: (-len(found[i][2]), found[i][1], int(last[i] - first[i]), int(first[i]), found[i][0]))
        for i in order:
            t, m, hit = found[i]
            family = self.families.index(self.templates[t][0])
            taken = [claimed[x] for x in hit if x in claimed]
            if 2 * len(taken) > len(hit) and (len(taken) == len(hit) or len(hit) < m or family in taken):
                continue
            others = np.any([w for f, w in whole.items() if f != family], axis=0)
            if family in self.families_of(p[i]) and self.consistent(h, t, int(first[i]), int(last[i]), others):
                claimed.update((x, family) for x in hit if x not in claimed)
                out.append((t, int(first[i]), int(last[i]), float(p[i][family]), len(hit) / m))
        return out


def _densest(key: list[int], pos: list[int], pair: list[int], need: int, reach: int) -> list[list[int]]:
    """Disjoint runs of at most ``reach`` with the most different pairs, ``need`` or more: the places of their pairs."""
    out, free = [], [True] * len(key)
    while True:
        runs = []
        for i in range(len(key)):
            if not free[i]:
                continue
            seen: dict[int, int] = {}
            j = i
            while j < len(key) and free[j] and key[j] - key[i] <= reach:
                seen.setdefault(pair[j], j)
                j += 1
            if len(seen) >= need:
                end = max(seen.values())
                runs.append((-len(seen), key[end] - key[i], i, end, seen))
        taken = False
        for _, _, i, end, seen in sorted(runs, key=lambda r: r[:4]):
            if all(free[i : end + 1]):
                free[i : end + 1] = [False] * (end + 1 - i)
                out.append(sorted(pos[j] for j in seen.values()))
                taken = True
        if not taken:
            return out


def _units(templates: list[tuple[str, str, np.ndarray]], families: list[str], kept: list[np.ndarray], filler: np.ndarray, p: LicenseScan) -> list[tuple[np.ndarray, int, int]]:
    """(words, class, number of the statement that they stem from, -1 for those of the corpus and of loose words)."""
    rng = np.random.default_rng(p.seed)
    unknown, out = len(families), []
    said = [(text, families.index(f)) for f, text, _ in templates]
    said += [(form.format(*one), unknown) for one in FOREIGN for form in FOREIGN_FORMS]
    for number, (text, label) in enumerate(said):
        h = words_hash(text)
        for k in range(p.copies if label < unknown else p.copies // 3):
            part = h if k == 0 or label == unknown else h[rng.random(len(h)) > 0.1 * (k % 3)]
            before, after = (rng.choice(filler, rng.integers(0, 12)) if k % 2 else filler[:0] for _ in "ab")
            out.append((np.concatenate((before, part if len(part) else h, after)), label, number))
    for number, text in enumerate(LOOKALIKES, len(said)):
        h = words_hash(text)
        out += [(np.concatenate((h, rng.choice(filler, k % 12))), unknown, number) for k in range(p.copies)]
    words = np.concatenate([words_hash(t) for _, t, _ in templates])
    for k in range(10 * p.copies):  # licence words in no order
        out.append((np.concatenate((rng.choice(words, 1 + k % 4), rng.choice(filler, 4 + k % 20))), unknown, -1))
    return out + [(h, unknown, -1) for h in kept]


def _fitted(model: Classifier, x: np.ndarray, y: np.ndarray) -> None:
    """Full-batch gradient descent with momentum, classes weighing alike; units are in single precision."""
    p, classes = model.params, len(model.families) + 1
    model.weights, model.bias, model.temperature = np.zeros((len(model.vocabulary), classes)), np.zeros(classes), 1.0
    target = np.eye(classes)[y]
    importance = (1 / np.bincount(y, minlength=classes).clip(1))[y][:, None]
    importance /= importance.sum()
    vw, vb = np.zeros_like(model.weights), np.zeros_like(model.bias)
    for _ in range(p.steps):
        z = x @ model.weights.astype(np.float32) + model.bias
        z = np.exp(z - z.max(1, keepdims=True))
        g = (z / z.sum(1, keepdims=True) - target) * importance
        vw = 0.9 * vw - 4.0 * (x.T @ g.astype(np.float32) + 1e-5 * model.weights)
        vb = 0.9 * vb - 1.0 * g.sum(0)
        model.weights += vw
        model.bias += vb


def train(negatives: list[str], p: LicenseScan = LicenseScan()) -> Classifier:
    """Fits on the templates, whole and damaged, foreign licences, look-alikes and ``negatives``."""
    families = list(TEMPLATES)
    templates = [(f, t, np.unique(grams(words_hash(t), 2 if len(words_hash(t)) > 1 else 1))) for f, ts in TEMPLATES.items() for t in ts]
    statements = [*(t for _, t, _ in templates), *LOOKALIKES, *(form.format(*one) for one in FOREIGN for form in FOREIGN_FORMS)]
    vocabulary = np.unique(np.concatenate([grams(words_hash(s), k) for s in statements for k in (1, 2, 3)]))
    model = Classifier(families, vocabulary, np.zeros((len(vocabulary), len(families) + 1)), np.zeros(len(families) + 1), 1.0, templates, p)
    kept = [h for h in map(words_hash, negatives) if len(h) and not any(np.isin(t, grams(h, 2)).mean() >= p.cover for _, _, t in templates)]
    filler = np.concatenate(kept) if kept else words_hash(" ".join(LOOKALIKES))
    units = _units(templates, families, kept, filler, p)
    x, y = np.array([model.features(h) for h, _, _ in units], np.float32), np.array([label for _, label, _ in units])

    # the temperature is that of statements unseen as wholes: of each family with three templates or more one, a third
    # of the foreign licences and look-alikes, and a fifth of the corpus
    number = np.array([n for _, _, n in units])
    first = {f: next(i for i, (g, _, _) in enumerate(templates) if g == f) for f in families}
    away = {first[f] for f, ts in TEMPLATES.items() if len(ts) >= 3}
    away |= {len(templates) + len(FOREIGN_FORMS) * i + j for i in range(0, len(FOREIGN), 3) for j in range(len(FOREIGN_FORMS))}
    away |= set(range(len(templates) + len(FOREIGN_FORMS) * len(FOREIGN), int(number.max()) + 1, 3))
    test = np.isin(number, list(away)) | ((number < 0) & (np.arange(len(number)) % 5 == 4))
    _fitted(model, x[~test], y[~test])

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return -float(np.log(model.probabilities(x[test])[np.arange(test.sum()), y[test]].clip(1e-12)).mean())

    found = min(np.geomspace(0.2, 5, 25), key=loss)
    _fitted(model, x, y)
    model.temperature = found
    return model


def corpus_lines(docs: DataFrame, n: int, window: int = 48, text: str = "text", order: str = "doc_id") -> list[str]:
    """At most n windows of up to ``window`` words: of those documents with the least hash of id and text, one line each, at a place given by the hash."""
    total = docs.count()
    place = F.xxhash64(col(order).cast("string"), col(text), F.lit(n))
    below = min(2**63 - 1, -(2**63) + (2 * n + 64) * 2**64 // max(1, total))
    picked = docs.where(col(text).isNotNull()).select(place.alias("h"), col(text).alias("t")).where(F.col("h") <= F.lit(below)).dropDuplicates(["h"])
    line = F.split("t", "\n")
    picked = picked.select("h", F.element_at(line, (F.pmod("h", F.size(line)) + 1).cast("int")).alias("t"))
    words = F.split(F.trim("t"), r"\s+")
    start = F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.size(words) - window + 1)) + 1
    picked = picked.select("h", F.array_join(F.slice(words, start.cast("int"), window), " ").alias("t"))
    return [r.t for r in picked.orderBy("h").limit(n).collect()]


#: Words that only mark a comment where a line starts with them.
_COMMENT = np.array([words_hash(x)[0] for x in ("rem", "dnl", "c")])


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Line number (within its document) of every word, and its document."""
    newline = np.cumsum(w.data == 10)
    line = newline[w.start] if len(w.start) else np.zeros(0, np.int64)
    base = np.concatenate(([0], newline))[w.base[:-1]] if len(w.data) else np.zeros(w.n_docs, np.int64)
    doc = w.doc_of_word()
    return line - base[doc], doc


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether any of the columns differs from the row before; the first row does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _windows(begins: np.ndarray, keep: np.ndarray, p: LicenseScan) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of the windows of the runs that start where ``begins``; of kept words only."""
    first = np.flatnonzero(begins)
    last = np.concatenate((first[1:], [len(begins)]))
    first, last = first[keep[first]], last[keep[first]]
    half = p.window // 2
    n = np.maximum(1, -(-(last - first - half) // half))
    s = np.repeat(first, n) + half * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return s, np.minimum(np.repeat(last, n), s + p.window)


def _mentions(model: Classifier, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple]:
    """(family, first and last word, probability, template, cover, confirmed) of windows; overlapping ones of a family are one."""
    p = model.judge(h, first, last)
    out: dict[int, list[list]] = {}
    for u in np.flatnonzero(1 - p[:, -1] >= model.params.least).tolist():
        a, b = int(first[u]), int(last[u])
        for f, probability in model.named(h[a:b]):
            found = [a, b, probability, *model.best_template(h[a:b], f)]
            mine = out.setdefault(f, [])
            if mine and a < mine[-1][1]:
                one = mine[-1]
                one[1] = b
                one[2] = max(one[2], found[2])
                if (found[5], found[4]) > (one[5], one[4]):
                    one[3:] = found[3:]
            else:
                mine.append(found)
    return [(f, *x) for f, found in out.items() for x in found]


def scan_licenses(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per statement and mention: doc_id, line (from 0), family, probability, template, cover, confirmed, first_word, last_word.

    The words are numbered within the document from 0, ``last_word`` included;
    ``line`` is that of the first one.  Null and empty texts and texts without
    known words give no row; repeated rows give repeated findings; ids may be of
    any type; other columns are not read.
    """
    p = model.params

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows = [], []
            for w in words_of(batch.column(1)):
                if not len(w.hash):
                    continue
                line, doc = _lines(w)
                words = np.flatnonzero(~(_changes(line, doc) & np.isin(w.hash, _COMMENT)))
                if not len(words):
                    continue
                h, line, doc = w.hash[words], line[words], doc[words]
                blank = np.zeros(len(h), np.int64)
                blank[1:] = np.cumsum(np.diff(line) > 1)
                paragraph = np.cumsum(_changes(blank, doc))
                found, claimed = [], np.zeros(len(h), bool)
                for t, a, b, probability, cover in model.statements(h, paragraph):
                    family, template, _ = model.templates[t]
                    found.append((family, a, b, probability, template, cover, True))
                    claimed[a:b] = True
                # mentions in what is left: first those within lines, then those across them
                for across in (False, True):
                    first, last = _windows(_changes(paragraph if across else line, doc, claimed), ~claimed, p)
                    if across:
                        more = line[first] != line[last - 1]
                        first, last = first[more], last[more]
                    for f, a, b, *rest in _mentions(model, h, first, last):
                        found.append((model.families[f], a, b, *rest))
                        claimed[a:b] = True
                for family, a, b, probability, template, cover, sure in sorted(found, key=lambda x: (x[1], x[2], x[0])):
                    d = int(doc[a])
                    zero = int(w.bounds[d])
                    of.append(w.first + d)
                    rows.append((int(line[a]), family, probability, template, cover, bool(sure), int(words[a]) - zero, int(words[b - 1]) - zero))
            if rows:
                types = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]
                names = ["doc_id", "line", "family", "probability", "template", "cover", "confirmed", "first_word", "last_word"]
                yield pa.record_batch([batch.column(0).take(pa.array(of)), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    docs = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    kinds = "line long, family string, probability double, template string, cover double, confirmed boolean, first_word long, last_word long"
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}")
