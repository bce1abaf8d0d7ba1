"""Licence notices in documents: a paragraph classifier over word n-grams, confirmed against templates.

Method: a paragraph is a block of neighbouring lines, up to a line without a word, so that a notice may
be wrapped at any width. Its stretches are scored: each of its lines, windows of 8 to 64 words that half
overlap, and every stretch of at most 1.5 times a template's words that holds `CONFIRM` of the
template's word pairs. A stretch is a bag of word n-grams, of one to three words, over the words of the licence
templates; a multinomial logistic regression in numpy gives the probabilities of each licence family,
of `unknown` (words about rights that name no family) and of `none`. It is fitted on varied copies
of the templates, on made-up notices without a family, and on lines of the documents, and cuts of them,
that are not like any template. A temperature is fitted on copies held back, and a family is only accepted
from the joint probability of all families on that 99 of 100 of the held-back stretches of other classes do not reach;
below it a notice is `unknown`. Every accepted family is then compared with its templates: `similarity`
is the largest share of a template's word pairs that the stretch holds. It is `confirmed` by a template of which the
stretch holds at least `CONFIRM`, every pair that ends in a number (so versions agree), and for each other
family a pair that no template of that one has (so what families share confirms neither). If the classifier's guess is not
confirmed, but one other family alone is, by a larger share, that family is the answer. What is not confirmed is reported as
`unknown`, with the guess beside it, if the stretch holds at least `LIKE` of a template; otherwise it is no notice. Where
families are as similar, as with a sentence that two of them have, the guess names them all, joined by `|`, and it
is the one of them that another stretch of the same text confirms, if there is just one.

Result: of stretches that overlap, one counts: confirmed ones first, then those found by a template, lines,
windows. Each has a row, whose `paragraph` is the number of the line in which it begins; notices of one family
that begin in one line are one row, notices of several families there are several.

Fitting: at most `negatives` lines of `sample_docs` documents, those with the smallest hash of their id; longer
lines in pieces of 64 words. Scoring covers every word of every text; the size of a line or paragraph does not
matter, since a notice of up to 33 words lies whole in a window of less than four times its words (of eight words for
shorter ones), and templates are looked for at their own length.

Edge cases: null and empty texts and blank lines give no rows; rows with a null id are scanned; repeated
rows each have their rows; texts and lines of any length are whole; without any paragraph of
documents to fit on, made-up ones stand alone; further columns are not looked at.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.textblocks import plain_words, runs, slices, text_bytes

# The names of licence families and the sentences by which texts refer to them.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "LGPL-2.1": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "SPDX-License-Identifier: ISC",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "MPL-1.1": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1.",
        "Licensed under the Mozilla Public License, version 1.1.",
    ),
    "Apache-1.1": (
        "Licensed under the Apache Software License, Version 1.1.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-3.0": (
        "Licensed under CC BY 3.0.",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
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
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
}
#: Notices that name no family.
OTHERS = (
    "All rights reserved.",
    "Copyright by the author. All rights reserved. No part of this work may be reproduced without written permission.",
    "Licensed under the terms of the house license.",
    "Licensed under a proprietary license, version 1.",
    "Use of this file is subject to the license agreement.",
    "This work is released under its own license; see the license file.",
    "Distributed under the terms of the publisher's public license.",
)
#: All of them, in the order of the families.
TEXTS = [t for k in TEMPLATES for t in TEMPLATES[k]] + list(OTHERS)
NONE, UNKNOWN = "none", "unknown"
CONFIRM, LIKE = 0.6, 0.2
#: Words of the windows in which paragraphs are scored besides their lines; the next window begins after half of one.
WINDOWS = (8, 16, 32, 64)
#: Words of stretches that are scored at once.
PART_WORDS = 1 << 19
FOUND = "doc_id long, paragraph int, family string, guess string, probability double, similarity double, confirmed boolean"


def words_of(text: str) -> list[str]:
    """The same words as `plain_words` hashes."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lowered)


def _hash(words: list[str]) -> np.ndarray:
    return plain_words(pa.array([" ".join(words)], pa.string()))[0]


class _Taken:
    """Stretches that do not overlap."""

    def __init__(self):
        self.starts, self.ends = [], []

    def meets(self, a: int, b: int) -> bool:
        i = bisect.bisect_left(self.ends, a + 1)
        return i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> bool:
        """Adds the stretch and says so, unless it overlaps one that is there."""
        if self.meets(a, b):
            return False
        i = bisect.bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


class Features:
    """Numbers of the n-grams over the template words; a paragraph is looked up as word numbers."""

    def __init__(self, texts: list[str]):
        lists = [words_of(t) for t in texts]
        # whole numbers are words, whether a template has them or not, so that another version breaks a pair
        self.words = sorted({w for x in lists for w in x} | {str(i) for i in range(10)})
        place = {w: i for i, w in enumerate(self.words)}
        hashes = _hash(self.words)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        base = len(self.words) + 1
        grams = set()
        for x in lists:
            n = [place[w] for w in x]
            for k in (1, 2, 3):
                grams.update(self._key(n[i : i + k], base) for i in range(len(n) - k + 1))
        self.base, self.grams = base, np.array(sorted(grams), np.int64)
        #: Pairs of neighbouring words of each text, as keys; the texts of each pair, flat.
        self.pairs = [{self._key(p, base) for p in zip(n, n[1:], strict=False)} for n in ([place[w] for w in x] for x in lists)]
        self.reach = np.array([len(x) * 3 // 2 + 2 for x in lists])
        self.pair_keys = np.array(sorted(set().union(*self.pairs)), np.int64)
        holders = [[t for t, have in enumerate(self.pairs) if k in have] for k in self.pair_keys.tolist()]
        self.held_at = np.cumsum([0] + [len(h) for h in holders])
        self.held_by = np.array([t for h in holders for t in h], np.int64)

    @staticmethod
    def _key(numbers: list[int], base: int) -> int:
        key = 0
        for n in numbers:
            key = key * base + n + 1
        return key

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words from 1 on; 0 for words that no template has."""
        spot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[spot] == hashes, self.order[spot] + 1, 0).astype(np.int64)

    def near(self, number: np.ndarray, at: np.ndarray, least: float) -> list[tuple[int, int]]:
        """Stretches of words inside a paragraph that hold at least `least` of the word pairs of a template.

        A stretch begins and ends with a pair of the template and has at most `reach` words; for each
        template the stretches do not overlap, those with the most pairs and the fewest other words first.
        """
        if len(number) < 2:
            return []
        key = np.where((number[:-1] > 0) & (number[1:] > 0), number[:-1] * self.base + number[1:], 0)
        ends = at[1:-1] - 1
        key[ends[(ends >= 0) & (ends < len(key))]] = 0
        spot = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        where = np.flatnonzero(self.pair_keys[spot] == key)
        held = self.held_at[spot[where] + 1] - self.held_at[spot[where]]
        first = np.cumsum(held) - held
        text = self.held_by[np.arange(held.sum()) - np.repeat(first - self.held_at[spot[where]], held)]
        place = np.repeat(where, held)
        order = np.lexsort((place, text))
        text, place = text[order], place[order]
        sizes = np.array([len(p) for p in self.pairs])
        need = np.maximum(np.ceil(least * sizes - 1e-9).astype(int), 1)
        # pairs from each place on, within reach and inside the paragraph; repeated ones count here, so this is a bound
        far = len(number) + 1
        joint = text * far + place
        end_of = at[np.searchsorted(at, place, side="right")]
        stop = np.searchsorted(joint, text * far + np.minimum(place + self.reach[text] - 1, end_of - 1))
        found: dict[int, list] = {}
        keys, places = key.tolist(), place.tolist()
        for i in np.flatnonzero(stop - np.arange(len(joint)) >= need[text]).tolist():
            seen, best, t = set(), None, int(text[i])
            for j in range(i, int(stop[i])):
                if keys[places[j]] in seen:
                    continue
                seen.add(keys[places[j]])
                size = places[j] + 2 - places[i]
                if len(seen) >= need[t]:
                    best = max(best or (-1e9, 0), (len(seen) - 0.2 * (size - 1 - len(seen)), size))
            if best:
                found.setdefault(t, []).append((-best[0], places[i], places[i] + best[1]))
        out = set()
        for stretches in found.values():
            taken = _Taken()
            out.update((a, b) for _, a, b in sorted(stretches) if taken.add(a, b))
        return sorted(out)

    def rows(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(paragraph, feature) of every known n-gram inside a paragraph, in the order of the paragraphs."""
        return self.numbered_rows(self.numbers(hashes), at)

    def numbered_rows(self, number: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = np.flatnonzero(number)
        of = np.searchsorted(at, known, side="right") - 1
        out_p, out_f = [], []
        key, going = number[known], np.ones(len(known), bool)
        for k in (1, 2, 3):
            if k > 1:
                after = known + k - 1
                inside = after < at[of + 1]
                step = np.where(inside, number[np.minimum(after, len(number) - 1)], 0) if len(number) else number
                going &= step > 0
                key = key * self.base + step
            spot = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
            hit = going & (self.grams[spot] == key)
            out_p.append(of[hit])
            out_f.append(spot[hit])
        # a word that a paragraph repeats counts once
        pairs = np.unique(np.concatenate(out_p) * len(self.grams) + np.concatenate(out_f))
        return pairs // len(self.grams), pairs % len(self.grams)


class Classifier:
    def __init__(self, features: Features, families: list[str]):
        self.features, self.families = features, families
        self.classes = [NONE, UNKNOWN, *families]
        self.w = np.zeros((len(features.grams) + 1, len(self.classes)))
        self.b = np.zeros(len(self.classes))
        self.temperature, self.least = 1.0, 0.5
        self.evidence = Evidence(features)

    def logits(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sparse sums of the weights, over the square root of the words of a paragraph."""
        return self._sums(*self.features.rows(hashes, at), at)

    def _sums(self, p: np.ndarray, f: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros((len(at) - 1, len(self.classes)))
        if len(p):
            first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            total[p[first]] = np.add.reduceat(self.w[f], first, axis=0)
        return total / np.sqrt(np.maximum(np.diff(at), 1))[:, None] + self.b

    def probabilities(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._shares(self.logits(hashes, at))

    def _shares(self, z: np.ndarray) -> np.ndarray:
        z = z / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def of_stretches(self, number: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probabilities of stretches of numbered words, which may overlap; some `PART_WORDS` are laid out at once."""
        out = np.zeros((len(starts), len(self.classes)))
        upto = np.cumsum(ends - starts)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PART_WORDS, side="right")))
            size = ends[i:j] - starts[i:j]
            at = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
            laid = number[np.arange(at[-1]) - np.repeat(at[:-1] - starts[i:j], size)]
            out[i:j] = self._shares(self._sums(*self.features.numbered_rows(laid, at), at))
            i = j
        return out

    def fit(self, texts: list[str], labels: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> None:
        hashes, at = plain_words(pa.array(texts, pa.string()))
        p, f = self.features.rows(hashes, at)
        scale = 1 / np.sqrt(np.maximum(np.diff(at), 1))
        weight = (1 / np.bincount(labels, minlength=len(self.classes)).clip(1))[labels]
        weight /= weight.sum()
        truth = np.eye(len(self.classes))[labels]
        order = np.argsort(f, kind="stable")
        ps, fs = p[order], f[order]
        first = np.flatnonzero(np.concatenate(([True], fs[1:] != fs[:-1])))
        squares, square_b = np.full_like(self.w, 1e-8), np.full_like(self.b, 1e-8)
        for _ in range(steps):
            z = self.logits(hashes, at)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            error = (e / e.sum(axis=1, keepdims=True) - truth) * weight[:, None]
            g = decay * self.w
            g[fs[first]] += np.add.reduceat((error * scale[:, None])[ps], first, axis=0)
            squares += g * g
            square_b += error.sum(axis=0) ** 2
            self.w -= rate * g / np.sqrt(squares)
            self.b -= rate * error.sum(axis=0) / np.sqrt(square_b)

    def calibrate(self, texts: list[str], labels: np.ndarray) -> None:
        """Temperature by likelihood; the least probability of a family by the 99th percentile of other classes."""
        hashes, at = plain_words(pa.array(texts, pa.string()))

        def loss(t: float) -> float:
            self.temperature = t
            return -np.log(self.probabilities(hashes, at)[np.arange(len(labels)), labels] + 1e-12).mean()

        self.temperature = min(np.geomspace(0.2, 5, 25), key=loss)
        best = self.probabilities(hashes, at)[:, 2:].sum(axis=1)
        rest = best[labels < 2]
        self.least = float(np.clip(np.quantile(rest, 0.99) if len(rest) else 0.5, 0.5, 0.95))


def _pairs(words: list[str]) -> set:
    return set(zip(words, words[1:], strict=False)) or {tuple(words)}


class Evidence:
    """What of the templates a stretch has to hold so that a family is confirmed; made once for the features."""

    def __init__(self, features: Features):
        self.family = [k for k in TEMPLATES for _ in TEMPLATES[k]]
        self.pairs = features.pairs[: len(self.family)]
        numbers = {i + 1 for i, w in enumerate(features.words) if w.isdigit()}
        base = features.base
        self.versions = [{p for p in pairs if p % base in numbers} for pairs in self.pairs]
        # a further number after one of the template's is another version, but for a zero
        zero = features.words.index("0") + 1
        self.others = [
            {p % base * base + n for p in versions if p % base in numbers for n in numbers - {zero}} - pairs
            for versions, pairs in zip(self.versions, self.pairs, strict=True)
        ]
        everything = {k: set().union(*(p for p, f in zip(self.pairs, self.family, strict=True) if f == k)) for k in TEMPLATES}
        #: For each template, what every other family lacks of it.
        self.apart = [[pairs - everything[k] for k in TEMPLATES if k != f] for pairs, f in zip(self.pairs, self.family, strict=True)]

    def shares(self, mine: set) -> tuple[dict[str, float], dict[str, float]]:
        """Largest share of a template of each family that the pairs `mine` hold: of any template, and of one that confirms."""
        any_, sure = dict.fromkeys(TEMPLATES, 0.0), {}
        for family, pairs, versions, others, apart in zip(self.family, self.pairs, self.versions, self.others, self.apart, strict=True):
            share = len(mine & pairs) / len(pairs)
            any_[family] = max(any_[family], share)
            if share >= CONFIRM and versions <= mine and not mine & others and all(mine & own for own in apart):
                sure[family] = max(sure.get(family, 0.0), share)
        return any_, sure


def judged(evidence: Evidence, mine: set, guess: str, accepted: bool) -> tuple[str, float, bool]:
    """(family or guesses, similarity, confirmed) of a stretch that holds the word pairs `mine`."""
    shares, sure = evidence.shares(mine)
    best = max(sure.values(), default=0.0)
    first = [f for f, s in sure.items() if s == best]
    if accepted and guess in sure:
        return guess, sure[guess], True
    if accepted and len(first) == 1 and best > shares[guess] - 1e-9:
        return first[0], best, True
    alike = shares[guess]
    ties = [f for f in TEMPLATES if shares[f] == alike] if alike >= CONFIRM else [guess]
    return "|".join(ties if guess in ties else [guess]), alike, False


def pairs_of(features: Features, number: np.ndarray) -> set:
    """Keys of the neighbouring template words of a stretch."""
    return set((number[:-1] * features.base + number[1:])[(number[:-1] > 0) & (number[1:] > 0)].tolist())


def _varied(text: str, rng: np.random.Generator, filler: list[str]) -> str:
    """A copy with words left out, put in and around, as notices are found in the wild."""
    words = [w for w in text.split() if rng.random() > 0.08] or text.split()
    for _ in range(rng.integers(0, 3)):
        words.insert(int(rng.integers(0, len(words) + 1)), filler[int(rng.integers(0, len(filler)))])
    around = [filler[int(i)] for i in rng.integers(0, len(filler), rng.integers(0, 8))]
    return " ".join(words + around if rng.random() < 0.5 else around + words)


def _cut(words: list[str], rng: np.random.Generator) -> list[str]:
    """Some neighbouring words, as a window has them."""
    size = int(rng.integers(min(3, len(words)), len(words) + 1))
    first = int(rng.integers(0, len(words) - size + 1))
    return words[first : first + size]


def _plain(texts: pa.Array, features: Features) -> list[str]:
    """The words of all lines, at most as many as in the longest window, that are not in a stretch like a template."""
    lines, of, number = paragraphs(texts)
    hashes, words_at = plain_words(lines)
    near = _Taken()
    for a, b in features.near(features.numbers(hashes), blocks(of, number, words_at), 0.3):
        near.add(a, b)
    out = []
    for i, line in enumerate(lines.to_pylist()):
        words = words_of(line)
        for k in range(0, len(words), WINDOWS[-1]):
            some = words[k : k + WINDOWS[-1]]
            if not near.meets(int(words_at[i]) + k, int(words_at[i]) + k + len(some)):
                out.append(" ".join(some))
    return out


def train(docs: DataFrame, sample_docs: int = 1_000, negatives: int = 3_000, copies: int = 60, seed: int = 3) -> Classifier:
    """Fits and calibrates; `sample_docs` and `negatives` bound what is taken from the documents."""
    some = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts_ = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    features = Features(TEXTS)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(_plain(piece.column("text"), features), pa.string())], ["piece"])

    plain_ = texts_.select(F.col("text").cast("string").alias("text")).mapInArrow(pieces, "piece string").filter(F.length("piece") >= 20)
    plain = [r.piece for r in plain_.distinct().orderBy(F.xxhash64("piece"), "piece").limit(negatives).collect()]
    families = list(TEMPLATES)
    made = ["Chapter %d has the notes of the meeting and of the work that the group has to do." % i for i in range(50)]
    rng = np.random.default_rng(seed)
    filler = [w for t in (plain or made)[:500] for w in t.split()]
    texts, labels = [], []
    for i, family in enumerate(families):
        for t in TEMPLATES[family]:
            texts += [t] * 4 + [_varied(t, rng, filler) for _ in range(copies)]
            labels += [2 + i] * (copies + 4)
    for t in OTHERS:
        texts += [t] * 4 + [_varied(t, rng, filler) for _ in range(copies)]
        labels += [1] * (copies + 4)
    cuts = [" ".join(_cut(t.split(), rng)) for t in plain]
    texts += plain + cuts + made
    labels += [0] * (len(plain) + len(cuts) + len(made))
    labels = np.array(labels)
    held = rng.random(len(texts)) < 0.2
    model = Classifier(features, families)
    model.fit([t for t, h in zip(texts, held, strict=True) if not h], labels[~held])
    model.calibrate([t for t, h in zip(texts, held, strict=True) if h], labels[held])
    return model


def paragraphs(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines of all texts that are not empty, the text of each, and its number among the lines of the text."""
    data, offsets = text_bytes(texts)
    inside = data != 10
    starts, ends = runs(inside, offsets)
    of = np.searchsorted(offsets, starts, side="right") - 1
    breaks = np.flatnonzero(~inside)
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[of])
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts)))
    kept = pa.py_buffer(np.ascontiguousarray(data[inside]))
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), kept]), of, number


def blocks(of: np.ndarray, number: np.ndarray, words_at: np.ndarray) -> np.ndarray:
    """Offsets, in words, of the paragraphs: neighbouring lines of a text up to one without a word."""
    some = np.flatnonzero(np.diff(words_at) > 0)
    new = np.ones(len(some), bool)
    new[1:] = (of[some[1:]] != of[some[:-1]]) | (number[some[1:]] != number[some[:-1]] + 1)
    return np.append(words_at[some[new]], words_at[-1])


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows of all paragraphs; a shorter paragraph is one window."""
    size = np.diff(at)
    starts, ends = [], []
    for n, width in enumerate(WINDOWS):
        step = width // 2
        some = np.flatnonzero(size > (WINDOWS[n - 1] if n else 0))
        count = np.maximum(-(-(size[some] - step) // step), 1)
        first = np.cumsum(count) - count
        start = np.repeat(at[:-1][some], count) + step * (np.arange(count.sum()) - np.repeat(first, count))
        starts.append(start)
        ends.append(np.minimum(start + width, np.repeat(at[1:][some], count)))
    return np.concatenate(starts), np.concatenate(ends)


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, paragraph, family, guess, probability, similarity, confirmed) of every paragraph that is a notice."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                yield from _found(piece, sent.value)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def _found(piece: pa.RecordBatch, model: Classifier) -> Iterator[pa.RecordBatch]:
    lines, of, number = paragraphs(piece.column("text"))
    hashes, words_at = plain_words(lines)
    at = blocks(of, number, words_at)
    named = model.features.numbers(hashes)
    near = np.array(model.features.near(named, at, CONFIRM), np.int64).reshape(-1, 2)
    some = np.flatnonzero(np.diff(words_at) > 0)
    wide = windows(at)
    starts = np.concatenate((near[:, 0], words_at[some], wide[0]))
    ends = np.concatenate((near[:, 1], words_at[some + 1], wide[1]))
    kind = np.repeat([0, 1, 2], [len(near), len(some), len(wide[0])])
    chance = model.of_stretches(named, starts, ends)
    told = []
    for i in np.flatnonzero(chance[:, 0] < 0.5).tolist():
        a, b, best = int(starts[i]), int(ends[i]), int(chance[i, 2:].argmax())
        accepted = float(chance[i, 2:].sum()) >= model.least
        guess, alike, good = judged(model.evidence, pairs_of(model.features, named[a:b]), model.families[best], accepted)
        sure = float(max(chance[i, 2 + model.families.index(f)] for f in guess.split("|")))
        if alike < LIKE and chance[i, 1] < 0.5:
            continue
        told.append((not good, int(kind[i]), -alike, a - b, a, b, guess, sure))
    # what several families share belongs to the one of them that the same text confirms
    text_of = lambda a: int(of[np.searchsorted(words_at, a, side="right") - 1])
    named_in: dict[int, set] = {}
    for bad, *_, a, _, guess, _ in told:
        if not bad:
            named_in.setdefault(text_of(a), set()).add(guess)
    for n, (bad, by, alike, size, a, b, guess, sure) in enumerate(told):
        owner = named_in.get(text_of(a), set()) & set(guess.split("|")) if bad and "|" in guess else ()
        if len(owner) == 1:
            told[n] = (False, by, alike, size, a, b, *owner, sure)
    # the stretch of a notice keeps others from it; of what overlaps, confirmed and closest ones count
    rows, taken, seen = [], _Taken(), set()
    ids = piece.column("doc_id")
    for bad, _, alike, _, a, b, guess, sure in sorted(told):
        if not taken.add(a, b):
            continue
        i = int(np.searchsorted(words_at, a, side="right")) - 1
        family = UNKNOWN if bad else guess
        if (i, family) not in seen:
            seen.add((i, family))
            rows.append((i, a, (ids[int(of[i])].as_py(), int(number[i]), family, guess, sure, -alike, not bad)))
    rows = [r for _, _, r in sorted(rows, key=lambda r: r[:2])]
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
    names = ["doc_id", "paragraph", "family", "guess", "probability", "similarity", "confirmed"]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
