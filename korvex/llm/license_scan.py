"""Operator 4, licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line of the text, or several where lines are wrapped: a line of WRAP characters or more that ends no
sentence goes on in the next, up to a line without a word. If a wrapped paragraph is of no family, its lines are tried
one by one. A paragraph's word uni- and bigrams go through a multinomial logistic regression with an
L1 penalty, so most weights are 0 and a paragraph without a weighted n-gram is unknown without being scored. It is
trained on labelled rows, which are made from TEMPLATES and NOT_LICENCES by a fixed seed (training_rows, whose number
is the bound of the training set), or given. Rows of templates that a fold's model hasn't seen set a temperature that
calibrates the probabilities, and the cut below which a paragraph is unknown. A prediction is confirmed when enough of the bigrams of one of the
family's templates, or of the paragraph, are shared.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

UNKNOWN = "unknown"
CONFIRM = 0.5
WRAP, FOLDS = 40, 3
_TOKEN = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
_WORD = re.compile(r"\w")
_STOP = frozenset("the a an of to in and or for is are be by on with as this that it at from any all not no you your may under if was were has have which whom its their such other without use do so".split())

TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE in the project root for details.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is available under the Apache 2.0 license.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD 3-Clause License.",
        "Distributed under the BSD license.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GNU General Public License v3.0.",
        "Licensed under the GPL version 2.",
        "Released under the GNU GPL v3.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "Licensed under the GNU Lesser General Public License (LGPL).",
    ],
    "AGPL": [
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0",
        "Licensed under the GNU AGPL v3.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Creative Commons Attribution 3.0 Unported (CC BY 3.0)",
        "https://creativecommons.org/licenses/by/4.0/",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 (CC BY-NC-ND 4.0)",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal public domain dedication.",
        "This work is in the public domain.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
        "Released under the ISC License.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright Example Corporation. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No part of this publication may be reproduced, stored or transmitted in any form without the prior written permission of the publisher.",
    ],
}
#: Ways to name a licence, and what is named in the same way without being one.
FRAMES = [
    "Released under the {}.", "This project is licensed under the {}.", "License: {}", "Distributed under the terms of the {}; see the file COPYING.",
    "This software is available under the {} licence.", "The source code is covered by the {}, a copy of which is included.", "{}", "All files are provided under {} unless noted otherwise.",
]
NAMES = {
    "MIT": ["MIT License", "MIT", "Expat MIT licence"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "New BSD licence"],
    "GPL": ["GNU General Public License, version 3", "GPL v3", "GNU GPL version 2 or later"],
    "LGPL": ["GNU Lesser General Public License, version 2.1", "LGPL v3", "GNU LGPL"],
    "AGPL": ["GNU Affero General Public License, version 3", "AGPL v3", "GNU AGPL"],
    "MPL-2.0": ["Mozilla Public License 2.0", "MPL 2.0", "Mozilla Public License, version 2.0"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY 3.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA 3.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-SA 3.0"],
    "CC0": ["CC0 1.0 Universal public domain dedication", "CC0", "public domain dedication CC0 1.0"],
    "ISC": ["ISC License", "ISC", "ISC licence of the Internet Systems Consortium"],
    "proprietary": ["proprietary licence, all rights reserved", "proprietary and confidential terms", "exclusive copyright of the owner, all rights reserved"],
    "unknown": ["title of the first album", "roof of the old station", "terms of the peace treaty", "name Rainbow in 2004", "new road to the coast", "supervision of a judge", "guidance of her teacher", "care of the city"],
}
NOT_LICENCES = """The driver showed a licence and paid the fine. She works for a public company in the city. The general terms of trade are improving.
Please see the file for details. Version 2.0 of the game was released in May. He was granted permission to leave the country.
The software is distributed to schools every year. All conditions were met by the team. The source of the river is in the mountains.
Our rights are protected by law. The notice was posted on the door. This work is hard and the pay is low. The commons were full of sheep.
A free copy of the book is given to every visitor. The creative industries grew last year. The foundation published its yearly report.
The university of technology has a new library. Modify the recipe with less sugar. The agreement was signed by both parties.
Contact us for more information about the product. The president said in a statement on Monday that talks would continue.
Click here to read the next page. Prices include tax and shipping. The weather was warm and the children played outside.
Fishing licences are sold at the office. The licence fee pays for public broadcasting. Apache helicopters flew over the town. The Apache people live in the southwest.
Students at MIT built a robot. The Mozilla festival takes place in autumn. A GNU is a large antelope. Attribution of the painting is disputed.
The name of the author is not known. Terms and conditions apply. Sign in to your account. The form must be filled in by hand.
The program starts at noon. The code of conduct was adopted. Copies of the report are available at the desk. Her reserved manner was misread.
The right of way is reserved for cyclists. Copyright law was debated in parliament. The domain name was sold to the public. Binary stars are common.""".replace("\n", " ").split(". ")


def grams(paragraph: str) -> list[str]:
    """Word unigrams and bigrams that hold a word which isn't a common one."""
    t = _TOKEN.findall(paragraph.lower())
    return [w for w in t if w not in _STOP] + [f"{a} {b}" for a, b in zip(t, t[1:]) if a not in _STOP or b not in _STOP]


def wordings(family: str) -> list[str]:
    """Texts of a family: its templates, and its names in every frame."""
    names = NAMES.get(family, [])
    return [*TEMPLATES.get(family, []), *[f.format(names[(k + j) % len(names)]) for k, f in enumerate(FRAMES) for j in range(2)]]


def training_rows(n: int = 120, seed: int = 11) -> list[tuple[str, str, int]]:
    """(paragraph, family, wording): n of each family, 8 n unknown ones: whole or cut wordings with words dropped, and filler around them."""
    r = random.Random(seed)
    filler = [w for s in NOT_LICENCES for w in s.split()]
    vocabulary = [w for ts in TEMPLATES.values() for t in ts for w in t.split()]
    out = []
    for family in TEMPLATES:
        ts = wordings(family)
        for k in range(n):
            w = ts[k % len(ts)].split()
            if len(w) > 12 and r.random() < 0.4:
                a = r.randrange(len(w) - 10)
                w = w[a : a + r.randrange(10, 25)]
            if r.random() < 0.4 and len(w) > 6:
                w = [x for x in w if r.random() > 0.08]
            if r.random() < 0.4:
                w = [r.choice(filler) for _ in range(r.randrange(1, 8))] + w
            if r.random() < 0.4:
                w = w + [r.choice(filler) for _ in range(r.randrange(1, 8))]
            out.append((" ".join(w), family, k % len(ts)))
    others = [*NOT_LICENCES, *wordings(UNKNOWN) * 3]
    for k in range(8 * n):
        w = others[k % len(others)].split()
        how = r.random()
        if how < 0.4:
            w = [r.choice(filler) for _ in range(r.randrange(3, 30))]
        elif how < 0.6:  # words of licences in no order
            w = [r.choice(vocabulary) for _ in range(r.randrange(1, 4))] + [r.choice(filler) for _ in range(r.randrange(3, 25))]
            r.shuffle(w)
        out.append((" ".join(w), UNKNOWN, k % len(others)))
    r.shuffle(out)
    return out


@dataclass(frozen=True)
class LicenceModel:
    families: list[str]  # UNKNOWN last
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float
    cut: float

    def logits(self, paragraph: str) -> np.ndarray:
        z = self.bias.copy()
        for g in set(grams(paragraph)):
            w = self.weights.get(g)
            if w is not None:
                z += w
        return z

    def probabilities(self, paragraph: str) -> np.ndarray:
        z = self.logits(paragraph) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, paragraph: str) -> tuple[str, float]:
        """Family and its calibrated probability; unknown where that is below the cut."""
        p = self.probabilities(paragraph)
        k = int(p.argmax())
        return (self.families[k], float(p[k])) if p[k] >= self.cut and k < len(p) - 1 else (UNKNOWN, float(p[-1]))


def _regress(train: list[tuple], families: list[str], l1: float, steps: int) -> LicenceModel:
    """Proximal gradient steps with momentum."""
    names = sorted(g for g, n in Counter(g for p, *_ in train for g in set(grams(p))).items() if n > 1)
    col = {g: k for k, g in enumerate(names)}
    x = np.zeros((len(train), len(names)), np.float32)
    for k, (p, *_) in enumerate(train):
        x[k, [col[g] for g in set(grams(p)) if g in col]] = 1
    y = np.zeros((len(train), len(families)), np.float32)
    y[np.arange(len(train)), [families.index(r[1]) for r in train]] = 1
    w, b = np.zeros((len(names), len(families)), np.float32), np.zeros(len(families), np.float32)
    v, t, rate = w.copy(), 1.0, 4.0 / max(1.0, float((x.sum(1)).mean()) if len(train) else 1.0)
    for _ in range(steps):
        z = x @ v + b
        e = np.exp(z - z.max(1, keepdims=True))
        g = (e / e.sum(1, keepdims=True) - y) / max(1, len(train))
        new = v - rate * (x.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        b = b - rate * g.sum(0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return LicenceModel(families, {n: r.astype(np.float64) for n, r in zip(names, w) if np.abs(r).max() > 1e-6}, b.astype(np.float64), 1.0, 0.0)


def fit(rows: list[tuple], l1: float = 3e-4, steps: int = 200, folds: int = FOLDS) -> LicenceModel:
    """A model of all rows (paragraph, family, template or nothing). Null paragraphs or families don't count.

    To calibrate, a model is fitted for each fold without the templates of that fold, and judges their rows. A template
    is its family's number of it; rows without one are dealt one by one.
    """
    rows = [(p, y, *(t or [k])) for k, (p, y, *t) in enumerate(rows) if p and y]
    families = sorted({r[1] for r in rows} - {UNKNOWN}) + [UNKNOWN]
    z, k = [], []
    for fold in range(folds):
        m = _regress([r for r in rows if r[2] % folds != fold], families, l1, steps)
        held = [r for r in rows if r[2] % folds == fold]
        z += [m.logits(r[0]) for r in held]
        k += [families.index(r[1]) for r in held]
    m = _regress(rows, families, l1, steps)
    if not rows:
        return m
    q, of = np.array(z), np.array(k)

    def probabilities(temp: float) -> np.ndarray:
        e = np.exp((q - q.max(1, keepdims=True)) / temp)
        return e / e.sum(1, keepdims=True)

    temp = min((0.2 * 1.15**i for i in range(30)), key=lambda x: float(-np.log(np.maximum(probabilities(x)[np.arange(len(of)), of], 1e-300)).mean()))
    p = probabilities(temp)
    last = len(families) - 1
    wrong = p.max(1)[(of == last) & (p.argmax(1) < last)]
    return LicenceModel(families, m.weights, m.bias, temp, float(max(0.5, np.quantile(wrong, 0.9))) if len(wrong) else 0.5)


@lru_cache(1)
def default_model() -> LicenceModel:
    return fit(training_rows())


def _pairs(paragraph: str) -> frozenset[str]:
    t = _TOKEN.findall(paragraph.lower())
    return frozenset(f"{a} {b}" for a, b in zip(t, t[1:])) or frozenset(t)


@lru_cache(1)
def _template_pairs() -> dict[str, list[frozenset[str]]]:
    return {f: [_pairs(t) for t in wordings(f)] for f in TEMPLATES}


def template_similarity(paragraph: str, family: str) -> float:
    """Largest share of bigrams that the paragraph and one of the family's templates have in common, of the shorter of the two."""
    p = _pairs(paragraph)
    return max((len(p & t) / min(len(p), len(t)) for t in _template_pairs().get(family, []) if p and t), default=0.0)


def paragraphs(text: str | None) -> list[list[tuple[int, int]]]:
    """Of each paragraph, the (start, end) of its lines. Lines without a word belong to none."""
    out: list[list[tuple[int, int]]] = []
    at, goes_on = 0, False
    for line in text.split("\n") if text else []:
        if not _WORD.search(line):
            goes_on = False
        else:
            if goes_on:
                out[-1].append((at, at + len(line)))
            else:
                out.append([(at, at + len(line))])
            goes_on = len(line) >= WRAP and not line.rstrip().endswith((".", "!", "?", ":", ";"))
        at += len(line) + 1
    return out


def licences(text: str | None, model: LicenceModel, lookup: frozenset[str] | None = None) -> list[tuple[int, int, int, str, float, float]]:
    """(paragraph number, start, end, family, probability, template similarity) of each paragraph, or line of one, with a known family."""
    out = []
    words = lookup if lookup is not None else trigger_words(model)
    for n, lines in enumerate(paragraphs(text)):
        likely = [(a, b) for a, b in lines if not words.isdisjoint(_TOKEN.findall(text[a:b].lower()))]  # type: ignore[index]
        for a, b in [(lines[0][0], lines[-1][1]), *(likely if len(lines) > 1 else [])] if likely else []:
            part = text[a:b]  # type: ignore[index]
            family, p = model.predict(part)
            if family != UNKNOWN:
                out.append((n, a, b, family, p, template_similarity(part, family)))
                if a == lines[0][0] and b == lines[-1][1]:
                    break
    return out


def trigger_words(model: LicenceModel) -> frozenset[str]:
    """Words of the n-grams that have a weight: a paragraph with none of them has the logits of an empty one."""
    words = frozenset(w for g in model.weights for w in g.split() if w not in _STOP)
    return words if model.predict("")[0] == UNKNOWN else frozenset(w for w in words | _STOP)


def scan(docs: DataFrame, model: LicenceModel | None = None, confirm: float = CONFIRM) -> DataFrame:
    """(doc_id, paragraph, start, end, family, probability, similarity, confirmed): a row for each paragraph of a known family, or for its lines.

    Null and empty texts give none; a null id stays null; repeated rows give repeated results. Of families of equal
    probability the first by name counts.
    """
    m = model or default_model()

    def run(rows):
        look = trigger_words(m)
        for ids, texts in C.batches(rows):
            got = [(i, *x) for i, t in zip(ids, texts) for x in licences(t, m, look)]
            c = list(zip(*got)) if got else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*[pa.array(x, k) for x, k in zip(c, kinds)], pa.array([x >= confirm for x in c[6]], pa.bool_())], ["doc_id", "paragraph", "start", "end", "family", "probability", "similarity", "confirmed"])

    return C.id_text(docs).mapInArrow(run, "doc_id long, paragraph long, start long, end long, family string, probability double, similarity double, confirmed boolean")


def op4_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))


QUERIES = {"op4_license_scans": op4_license_scans}
SQL: dict[str, str] = {}
