"""Licence scans by a trained paragraph classifier.

Texts are cut into paragraphs at blank lines (a notice wrapped over several lines is one
paragraph); longer ones are read in windows of WINDOW words that overlap by half, so that text far
away can't outvote a notice. Word unigrams (other than common words), bigrams and trigrams feed a
sparse multinomial logistic regression (L1: most weights are exactly zero) over licence families, a
class ``unknown`` of licences outside the list, and ``none``. It is trained here on notices and
their variations, on notices of other licences and made-up ones, and on a bounded sample of the
scanned corpus as ``none``. A temperature and the weight of ``unknown`` are calibrated on held-out
variations and on licences that training never saw.

The classifier sees every paragraph with an n-gram of nonzero weight; any other is ``none`` by its
bias. What it predicts counts only if a stretch of the paragraph holds enough of one of the family's
templates, and no other family's template holds more there. Then that stretch is taken out and the
rest classified again, so a paragraph may hold several notices. Parts of one header are one notice.

One pass over the rows, no shuffle.

Defined results: null and empty texts have no notice; rows are scanned one by one, so
repeated rows give repeated results; notices come in text order, families sorted; where spans
overlap the one that holds more of its template stays, then the one first in the text, then the
family first in the alphabet; columns other than ``doc_id`` and ``text`` are not read; an empty
table gives an empty result (and the classifier then trains without samples of the corpus); texts
of any length are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.words import DocBatch, map_texts

NONE, UNKNOWN = "none", "unknown"
RESERVED = "all-rights-reserved"
#: Words of a window; longer paragraphs are read in several.
WINDOW = 120
#: As many bigrams of one template close together are its notice, however much longer the template is.
SURE = 12
#: Parts of a header so many words apart are one notice.
JOIN = 30
FILTER_BITS = 22
#: What notices of each family say (titles, grants, SPDX lines).
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS',
        "See the License for the specific language governing permissions and limitations under the License",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License 2.0",
    ],
    "mit": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the terms of the MIT license",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
    ],
    "gpl-3.0": [
        "GNU General Public License v3.0",
        "released under version 3 of the GNU General Public License",
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License version 3",
        "Licensed under the GPLv3",
    ],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "GNU General Public License v2.0",
        "released under version 2 of the GNU General Public License",
        "This work is licensed under the GNU General Public License, version 2",
        "either version 2 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: GPL-2.0-only",
        "GNU General Public License version 2",
        "Licensed under the GPLv2",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "Licensed under the LGPL",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "This work is licensed under the GNU Lesser General Public License, version 3",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "GNU Lesser General Public License version 2.1",
    ],
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "Licensed under the AGPLv3",
        "This work is licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "Released under the BSD License",
        "Licensed under the 3-Clause BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "mpl-2.0": [
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License",
        "SPDX-License-Identifier: ISC",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "Licensed under CC0 1.0 Universal",
    ],
    "all-rights-reserved": [
        "All rights reserved",
        "Copyright the authors, all rights reserved",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher",
        "Proprietary and confidential, unauthorized copying of this file is strictly prohibited",
    ],
}
#: Notices of licences outside the list. Every other one trains the class ``unknown``; the rest are held out to calibrate it.
OTHERS = {
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "cddl": ["The contents of this file are subject to the terms of the Common Development and Distribution License", "SPDX-License-Identifier: CDDL-1.0"],
    "apache-1.1": ["The Apache Software License, Version 1.1", "This product includes software developed by the Apache Software Foundation", "SPDX-License-Identifier: Apache-1.1"],
    "artistic": ["You may distribute under the terms of the Artistic License 2.0, as specified in the README file", "SPDX-License-Identifier: Artistic-2.0"],
    "boost": ["Distributed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0"],
    "zlib": ["This software is provided as-is, without any express or implied warranty; in no event will the authors be held liable for any damages arising from the use of this software", "SPDX-License-Identifier: Zlib"],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "Licensed under CC BY-ND 4.0"],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "cc-by-3.0": ["Licensed under CC BY 3.0 Unported", "This work is licensed under a Creative Commons Attribution 3.0 Unported License"],
    "eupl": ["Licensed under the EUPL, Version 1.2 or later", "SPDX-License-Identifier: EUPL-1.2"],
    "gnu-any": ["You should have received a copy of the GNU General Public License along with this program", "See the GNU General Public License for more details", "Free software under the GNU General Public License"],
    "gfdl": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3", "SPDX-License-Identifier: GFDL-1.3-only"],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1", "SPDX-License-Identifier: OFL-1.1"],
    "mpl-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1", "SPDX-License-Identifier: MPL-1.1"],
    "ms-pl": ["This code is licensed under the Microsoft Public License", "SPDX-License-Identifier: MS-PL"],
    "psf": ["Licensed to PSF under a Contributor Agreement", "SPDX-License-Identifier: PSF-2.0"],
    "wtfpl": ["This program is free software, it comes without any warranty, to the extent permitted by applicable law", "SPDX-License-Identifier: WTFPL"],
    "gpl-1.0": ["GNU General Public License version 1", "SPDX-License-Identifier: GPL-1.0-only"],
    "postgresql": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", "SPDX-License-Identifier: PostgreSQL"],
    "commercial": ["This software is licensed under the terms of your commercial agreement with the vendor", "Licensed under the vendor's end user license agreement"],
}
#: How notices name a licence; with made-up names they train ``unknown`` too.
FRAMES = ["Licensed under the {} License, Version 2.0", "Licensed under the {} License", "Released under the {} License", "This work is licensed under the {} Public License, version 3", "This work is licensed under the {} General License, version 2", "SPDX-License-Identifier: {}-2.0", "SPDX-License-Identifier: {}", "The {} License ({})", "Released under the {} License 1.0", "Licensed under {} 4.0", "under the terms of the {} Public License", "You may obtain a copy of the {} License at http://www.{}.org/license"]
#: Sentences near the subject that are no notice.
NEAR_MISSES = [
    "The driver lost his license after the accident",
    "She applied for a fishing license in March",
    "The bar was licensed to sell alcohol until midnight",
    "Every version of the story was different",
    "The apache helicopter landed under heavy fire",
    "He studied physics at MIT before moving to Berlin",
    "The general public was invited to the opening",
    "Human rights must be respected by all nations",
    "The table was reserved for all of us",
    "Permission to enter the building was granted by the guard",
    "The software was released in the spring and sold well",
    "The source of the river lies in the mountains",
    "Creative people share a common interest in art",
    "The work is done and the copies are ready",
    "The common rights of all members are reserved for later discussion",
]
#: Words too common to be features by themselves.
COMMON = "the of and a to in is for it with as be this that on by at or an are was you your from not may any all must will use".split()
WORD_BYTE = np.isin(np.arange(256), [*range(48, 58), *range(97, 123)]) | (np.arange(256) >= 0x80)


class Paragraphs(DocBatch):
    """Texts as letters and digits, cut into windows of paragraphs."""

    @cached_property
    def in_word(self) -> np.ndarray:
        return WORD_BYTE[self.data]

    @cached_property
    def paragraph_of_word(self) -> np.ndarray:
        """Number of each word's paragraph; paragraphs never span texts."""
        lines = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.data == 10, dtype=np.int64)])
        starts, ends = self.spans
        new = np.zeros(len(starts), bool)
        if len(starts):
            new[1:] = (lines[starts[1:]] - lines[ends[:-1]] >= 2) | (self.doc_of_word[1:] != self.doc_of_word[:-1])
        return np.cumsum(new)

    @cached_property
    def ngrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, hash and n of every n-gram, n from 1 to 3, inside paragraphs."""
        paragraph, out = self.paragraph_of_word, []
        for n in (1, 2, 3):
            at, h = self.grams(n)
            good = paragraph[at] == paragraph[np.minimum(at + n - 1, max(len(paragraph) - 1, 0))] if len(at) else np.zeros(0, bool)
            if n == 1:
                good &= ~np.isin(h, common_hashes())
            out.append((at[good], h[good], np.full(int(good.sum()), n)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    @cached_property
    def windows(self) -> np.ndarray:
        """First word and end of each window."""
        paragraph = self.paragraph_of_word
        if not len(paragraph):
            return np.zeros((0, 2), np.int64)
        first = np.flatnonzero(np.append(True, paragraph[1:] != paragraph[:-1]))
        end = np.append(first[1:], len(paragraph))
        n = np.maximum(1, -(-(end - first - WINDOW // 2) // (WINDOW // 2)))
        start = np.repeat(first, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * (WINDOW // 2)
        return np.stack([start, np.minimum(start + WINDOW, np.repeat(end, n))], axis=1)


def paragraphs(texts: list[str]) -> Paragraphs:
    return Paragraphs.of(pa.array(texts, pa.string()), lower=True)


def common_hashes() -> np.ndarray:
    return Paragraphs.of(pa.array(COMMON), lower=True).grams(1)[1]


@dataclass
class LicenceModel:
    families: list[str]
    known: np.ndarray  # hashes of n-grams with a nonzero weight, sorted
    weights: np.ndarray  # a row each and the bias; a column a family, then unknown, none
    temperature: float
    lift: float  # added to unknown's score
    templates: list[tuple[int, np.ndarray]]  # family and bigrams of each template, those of other licences too

    @cached_property
    def mask(self) -> np.ndarray:
        """Which top bits a known hash has: most n-grams need no search."""
        out = np.zeros(1 << FILTER_BITS, bool)
        out[(self.known >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return out

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash; -1: no weight."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.known):
            near = np.flatnonzero(self.mask[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.known, hashes[near]), len(self.known) - 1)
            good = self.known[at] == hashes[near]
            out[near[good]] = at[good]
        return out

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        """From summed weights without the bias."""
        z = z + self.weights[-1]
        z[:, -2] += self.lift
        z = z / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def variations(rng: np.random.Generator, text: str, filler: list[str], prose: list[str]) -> str:
    """A notice with words lost, case changed, or words or whole sentences around it."""
    words = text.split()
    if len(words) > 8:
        words = [w for w in words if rng.random() > 0.05]

    def around() -> list[str]:
        kind = rng.random()
        if kind < 0.5:
            return []
        return rng.choice(filler, rng.integers(1, 6)).tolist() if kind < 0.7 else rng.choice(prose, rng.integers(1, 7)).tolist()

    out = " ".join([*around(), *words, *around()])
    return out.upper() if rng.random() < 0.08 else out


def made_up(rng: np.random.Generator, filler: list[str]) -> str:
    """A notice of a licence that isn't there."""
    name = " ".join(rng.choice(filler, rng.integers(1, 3))).title()
    return str(rng.choice(FRAMES)).replace("{}", name)


def fit(row: np.ndarray, example: np.ndarray, y: np.ndarray, share: np.ndarray, n_rows: int, classes: int, rounds: int, l1: float) -> np.ndarray:
    """Multinomial logistic regression with L1, by proximal steps scaled to each weight's gradients."""
    weights, speed = np.zeros((n_rows + 1, classes)), np.full((n_rows + 1, classes), 1e-8)
    target = np.eye(classes)[y]
    for _ in range(rounds):
        z = np.stack([np.bincount(example, weights=weights[row, k], minlength=len(y)) for k in range(classes)], axis=1) + weights[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - target) * share[:, None]
        grad = np.stack([np.bincount(row, weights=g[example, k], minlength=n_rows + 1) for k in range(classes)], axis=1)
        grad[-1] = g.sum(axis=0)
        speed += grad * grad
        step = 0.5 / np.sqrt(speed)
        weights -= step * grad
        weights[:-1] = np.sign(weights[:-1]) * np.maximum(np.abs(weights[:-1]) - step[:-1] * l1, 0)
    return weights


def train(background: list[str], rounds: int = 150, copies: int = 12, l1: float = 5e-4, seed: int = 5) -> LicenceModel:
    """Fit on variations of the templates, other and made-up licences, NEAR_MISSES and background sentences."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    filler = sorted({w.strip(".,;:!?()").lower() for t in [*NEAR_MISSES, *background[:200]] for w in t.split()} - {""})[:2000]
    prose = background or NEAR_MISSES
    unknown, none = len(families), len(families) + 1
    examples: list[tuple[str, int, bool]] = []
    for i, f in enumerate(families):
        pairs = [f"{a}. {b}" for a, b in zip(TEMPLATES[f], TEMPLATES[f][1:], strict=False)]
        for t in [*TEMPLATES[f], *pairs]:
            examples += [(variations(rng, t, filler, prose) if c else t, i, c > 0 and rng.random() < 0.2) for c in range(copies)]
    for i, f in enumerate(sorted(OTHERS)):
        for t in OTHERS[f]:
            examples += [(variations(rng, t, filler, prose) if c else t, unknown, i % 2 == 1) for c in range(copies)]
    examples += [(variations(rng, made_up(rng, filler), filler, prose), unknown, rng.random() < 0.2) for _ in range(500)]
    examples += [(t, none, rng.random() < 0.2) for t in (NEAR_MISSES * 3 + background)]
    examples += [(" ".join(rng.choice(prose, 7)), none, rng.random() < 0.2) for _ in range(200)]
    y = np.array([k for _, k, _ in examples])
    held = np.array([h for _, _, h in examples])
    batch = paragraphs([" ".join(t.split()) for t, _, _ in examples])
    at, h, _ = batch.ngrams
    example = batch.doc_of_word[at]
    pair = np.unique(np.stack([h, example.astype(np.uint64)], axis=1), axis=0)  # an n-gram counts once an example
    h, example = pair[:, 0], pair[:, 1].astype(np.int64)
    # features are the n-grams of notices and near misses; what only stands around them tells nothing about licences
    own = [*(t for texts in (*TEMPLATES.values(), *(OTHERS[f] for i, f in enumerate(sorted(OTHERS)) if i % 2 == 0)) for t in texts), *(x.replace("{}", "\n\n") for x in FRAMES), *NEAR_MISSES]
    known = np.unique(paragraphs(own).ngrams[1])
    row = np.minimum(np.searchsorted(known, h), len(known) - 1)
    good = known[row] == h
    row, example = row[good], example[good]
    share = np.where(held, 0.0, 1.0) / np.bincount(y[~held], minlength=none + 1)[y] ** 0.5
    weights = fit(row, example, y, share, len(known), none + 1, rounds, l1)
    z = np.stack([np.bincount(example, weights=weights[row, k], minlength=len(y)) for k in range(none + 1)], axis=1)
    used = np.abs(weights[:-1]).max(axis=1) > 0
    bigrams = [(i, np.unique(bigrams_of(t))) for i, f in enumerate(families) for t in TEMPLATES[f]]
    bigrams += [(unknown, np.unique(bigrams_of(t))) for texts in OTHERS.values() for t in texts]  # rivals
    model = LicenceModel(families, known[used], np.concatenate([weights[:-1][used], weights[-1:]]), 1.0, 0.0, [b for b in bigrams if len(b[1])])
    even = 1 / np.bincount(np.minimum(y[held], unknown) if held.any() else [0], minlength=none + 1)[np.minimum(y[held], unknown)] if held.any() else np.zeros(0)
    best = np.inf
    for temperature in np.geomspace(0.5, 4, 13):
        for lift in np.linspace(-2, 4, 13):
            model.temperature, model.lift = float(temperature), float(lift)
            loss = -(even * np.log(model.probabilities(z[held].copy())[np.arange(int(held.sum())), y[held]] + 1e-12)).sum() if held.any() else 0
            if loss < best:
                best, chosen = loss, (float(temperature), float(lift))
    model.temperature, model.lift = chosen if held.any() else (1.0, 0.0)
    return model


def bigrams_of(text: str) -> np.ndarray:
    return paragraphs([" ".join(text.split())]).grams(2)[1]


def stretches(at: np.ndarray, hashes: np.ndarray, bigrams: np.ndarray, containment: float) -> tuple[int, int, int] | None:
    """First word, end and number of the template's bigrams of the part that holds most of them; None if none holds ``containment``.

    A part is at most as long as the template, and holds the share of the template's bigrams, or of SURE where it has more.
    """
    mine = np.flatnonzero(np.isin(hashes, bigrams))
    need = int(np.ceil(containment * min(len(bigrams), SURE) - 1e-9))
    if len(mine) < need:
        return None
    pos, ids, best = at[mine], hashes[mine], None
    stop = np.searchsorted(pos, pos + len(bigrams) + 1)
    for i in np.flatnonzero(stop - np.arange(len(pos)) >= need):
        own = len(np.unique(ids[i : stop[i]]))
        if own >= need and own >= containment * (pos[stop[i] - 1] - pos[i] + 1) and (best is None or own > best[2]):
            best = (int(pos[i]), int(pos[stop[i] - 1]) + 2, own)
    return best


def confirmed(at: np.ndarray, hashes: np.ndarray, family: int, model: LicenceModel, containment: float) -> tuple[int, int, int] | None:
    """First word, end and template bigrams of a family's notice among a window's bigrams; None if no template of it fits, or another family's fits better there."""
    own = [(*x, x[2] / len(b)) for f, b in model.templates if f == family and (x := stretches(at, hashes, b, containment))]
    if not own:
        return None
    start, end, most, share = max(own, key=lambda x: (x[2], x[3], -x[0]))
    inside = (at >= start - 1) & (at + 2 <= end + 1)
    if any((x[2], x[2] / len(b)) > (most, share) for f, b in model.templates if f != family and (x := stretches(at[inside], hashes[inside], b, containment))):
        return None
    for a, b, *_ in sorted(own):
        if a <= end + JOIN and b >= start - JOIN:
            start, end = min(start, a), max(end, b)
    return start, end, most


def joined(notices: list[tuple]) -> list[tuple]:
    """Notices (template bigrams, first word, end, family, probability) of a text, those of one family close together as one; rights reserved in the header of another licence are no notice of their own."""
    out: list[tuple] = []
    for x in sorted(notices, key=lambda x: (x[1], x[2])):
        if out and out[-1][3] == x[3] and x[1] <= out[-1][2] + JOIN:
            y = out.pop()
            x = (y[0] + x[0], y[1], max(x[2], y[2]), x[3], max(x[4], y[4]))
        out.append(x)
    following = [y for y in out if y[3] != RESERVED]
    return [x for x in out if x[3] != RESERVED or not any(x[2] <= y[1] <= x[2] + JOIN for y in following)]


def scan_batch(batch: Paragraphs, model: LicenceModel, threshold: float, containment: float) -> list[list[dict]]:
    """Notices of each text: start and end in bytes, family (or unknown), probability, and the share of the notice that its templates hold."""
    out: list[list[dict]] = [[] for _ in range(batch.n_docs)]
    windows = batch.windows
    if not len(windows):
        return out
    at, h, n = batch.ngrams
    row = model.rows(h)
    weighted = np.flatnonzero(row >= 0)
    last = np.searchsorted(windows[:, 0], at[weighted], "right") - 1  # the last window that begins before the n-gram, and the one before it
    pairs = [(w, k) for w, k in ((last, weighted), (last - 1, weighted))]
    window = np.concatenate([w for w, _ in pairs])
    gram = np.concatenate([k for _, k in pairs])
    inside = (window >= 0) & (at[gram] + n[gram] <= windows[np.maximum(window, 0), 1]) & (at[gram] >= windows[np.maximum(window, 0), 0])
    window, gram = window[inside], gram[inside]
    key = np.unique(window * len(model.weights) + row[gram])  # once a window
    window_, row_ = key // len(model.weights), key % len(model.weights)
    scored = np.unique(window_)
    place = np.searchsorted(scored, window_)
    z = np.stack([np.bincount(place, weights=model.weights[row_, k], minlength=len(scored)) for k in range(model.weights.shape[1])], axis=1) if len(scored) else np.zeros((0, model.weights.shape[1]))
    p = model.probabilities(z.copy())
    starts, ends = batch.spans
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    found: dict[int, list[tuple]] = {}
    for i in np.flatnonzero(p.argmax(axis=1) < model.weights.shape[1] - 1):
        a, b = windows[scored[i]]
        grams = order[np.searchsorted(ordered, a) : np.searchsorted(ordered, b)]
        grams = grams[at[grams] + n[grams] <= b]
        doc = int(batch.doc_of_word[a])
        while len(grams):
            rows = np.unique(row[grams])
            q = model.probabilities(model.weights[rows[rows >= 0]].sum(axis=0)[None, :])[0]
            k = int(q.argmax())
            if k >= len(model.families) or q[k] < threshold:
                if k == len(model.families) and q[k] >= threshold and len(grams):
                    found.setdefault(doc, []).append((0, int(a), int(b), UNKNOWN, float(q[k])))
                break
            two = grams[n[grams] == 2]
            span = confirmed(at[two], h[two], k, model, containment)
            if span is None:
                break
            found.setdefault(doc, []).append((span[2], span[0], span[1], model.families[k], float(q[k])))
            grams = grams[(at[grams] + n[grams] <= span[0]) | (at[grams] >= span[1])]
    for doc, all_ in found.items():
        named = sorted((x for x in all_ if x[3] != UNKNOWN), key=lambda x: (-x[0], x[1], x[3]))
        kept: list[tuple] = []
        for x in named:
            same = next((k for k, y in enumerate(kept) if y[3] == x[3] and x[1] <= y[2] and y[1] <= x[2]), None)
            if same is not None:  # seen in two windows
                y = kept[same]
                kept[same] = (y[0], min(x[1], y[1]), max(x[2], y[2]), y[3], max(x[4], y[4]))
            elif all(x[2] <= y[1] or x[1] >= y[2] for y in kept):
                kept.append(x)
        kept = joined(kept)
        unknown = [x for x in all_ if x[3] == UNKNOWN and not any(x[1] < y[2] and y[1] < x[2] for y in kept)]
        for hits, a, b, family, probability in sorted([*kept, *unknown], key=lambda x: (x[1], x[2], x[3])):
            out[doc].append({"start": int(starts[a]), "end": int(ends[b - 1]), "family": family, "probability": probability, "containment": min(1.0, hits / max(1, b - a - 1))})
    return out


def background(df: DataFrame, most: int) -> list[str]:
    """At most ``most`` sentences of the corpus, none of which names licences or rights: the bound on unlabelled rows that train ``none``."""
    sentence = F.explode(F.split("text", r"[\n.!?]+"))
    rows = df.where("text IS NOT NULL").where(F.pmod(F.xxhash64("text"), F.lit(64)) == 0).select(sentence.alias("s")).where(~F.lower("s").rlike(r"licen[cs]e|copyright|rights|spdx|public|permission|redistribut|unauthor")).where(F.length(F.trim("s")).between(8, 400))
    return [r["s"] for r in rows.orderBy(F.xxhash64("s"), "s").limit(most).collect()]


def scan_licences(df: DataFrame, threshold: float = 0.5, containment: float = 0.6, samples: int = 1500) -> DataFrame:
    """Per row of df (doc_id, text): n_notices, families (sorted, distinct), notices, and n_unknown, the paragraphs that look like a licence outside the list.

    ``samples`` bounds the corpus sentences that train the class ``none``. start and end of a
    notice are code points of the text.
    """
    model = df.sparkSession.sparkContext.broadcast(train(background(df, samples)))
    kind = df.schema["doc_id"].dataType.simpleString()
    notice = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("containment", pa.float64())])

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        batch = Paragraphs.of(part.column("text"), lower=True)
        found = scan_batch(batch, model.value, threshold, containment)
        chars = np.concatenate([np.zeros(1, np.int64), np.cumsum((batch.data & 0xC0) != 0x80)])
        for i, notices in enumerate(found):
            for x in notices:
                x["start"], x["end"] = (int(chars[x[k]] - chars[batch.offsets[i]]) for k in ("start", "end"))
        named = [[x for x in f if x["family"] != UNKNOWN] for f in found]
        families = [sorted({x["family"] for x in f}) for f in named]
        columns = [pa.array([len(f) for f in named], pa.int64()), pa.array(families, pa.list_(pa.string())), pa.array(named, pa.list_(notice)), pa.array([len(f) - len(g) for f, g in zip(found, named, strict=True)], pa.int64())]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_notices", "families", "notices", "n_unknown"])

    return map_texts(df.select("doc_id", "text"), one, f"doc_id {kind}, n_notices long, families array<string>, notices array<struct<start:bigint,end:bigint,family:string,probability:double,containment:double>>, n_unknown long")
