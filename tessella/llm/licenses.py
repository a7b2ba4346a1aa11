"""License scans: a trained paragraph classifier, confirmed by template comparison.

A paragraph ends at a blank line and at a line that ends a sentence, so a notice that is
wrapped over lines, with comment signs or not, is one paragraph, and a notice on a line of
its own is one as well. The features of one are its distinct word 2- and 3-grams; the
classifier is a multinomial logistic regression over the licence families, the class
"unknown" (licences of none of the families, trained on ``FOREIGN``) and the class "none",
trained on the driver from ``TEMPLATES``, variants of them, and sentences that are no
licence. Grams outside its vocabulary weigh nothing, so scoring needs only the grams that
meet the vocabulary, a constant of a few thousand rows that is broadcast.

Probabilities are tempered, and their bound is set, on ``CALIBRATION``, notices as people
write them, none of which is trained on. A paragraph whose likeliest class is a family is a
finding; it is given that family if its probability reaches the bound and it holds at least
``SHARE`` of the grams of one of the family's templates, and "unknown" otherwise. One whose
likeliest class is "unknown" is a finding of that.

Scoring is DataFrame expressions alone: words are exploded inside the scan's stage,
looked up, and only those that meet the vocabulary are shuffled, by document and paragraph.

Rows: null text has no paragraphs; documents that repeat id and text are reported as often
as they stand; a null doc_id is reported like any other.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.decontaminate import words

NONE, UNKNOWN = "none", "unknown"
SHARE = 0.5
SIZES = (2, 3)
SEED = 11
#: Of a calibration notice's class, so much is shared out among all classes.
SMOOTHING = 0.05

#: Public notices by family; fixed values.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "cc0": (
        "CC0 1.0 Universal Public Domain Dedication.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "gfdl": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License.",
        "SPDX-License-Identifier: GFDL-1.3-or-later",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "reserved": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without permission.",
    ),
}

#: Notices of licences that are none of the families; fixed values.
FOREIGN = (
    "Licensed under the Common Development and Distribution License, version 1.0.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the License).",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This program is licensed under the Artistic License 2.0.",
    "This software is provided as-is, without any express or implied warranty.",
    "In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "This license governs use of the accompanying software. If you use the software, you accept this license.",
    "You may use, distribute and modify this code under the terms of the XYZ license.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Licensed under the Academic Free License version 3.0.",
    "Licensed under the Open Software License version 3.0.",
    "Licensed under the Microsoft Public License (Ms-PL).",
    "Licensed under the Universal Permissive License v 1.0 as shown at",
    "This file is licensed under the terms of the Python Software Foundation License Version 2.",
    "This work is licensed under the Open Data Commons Open Database License.",
    "Distributed under the terms of the Ruby License.",
    "Distributed under the PHP License, version 3.01.",
    "Use of this software is subject to the license agreement.",
    "See the file LICENSE for copying permission.",
    "This product is licensed, not sold, under the terms of the end user license agreement.",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: CDDL-1.0",
    "SPDX-License-Identifier: EUPL-1.2",
    "SPDX-License-Identifier: Artistic-2.0",
    "SPDX-License-Identifier: MS-PL",
    "SPDX-License-Identifier: OFL-1.1",
    "SPDX-License-Identifier: PostgreSQL",
    "SPDX-License-Identifier: NCSA",
    "THE SOFTWARE IS PROVIDED AS IS AND THE COPYRIGHT HOLDER DISCLAIMS ALL WARRANTIES, EXPRESS OR IMPLIED.",
    "IN NO EVENT SHALL THE UNIVERSITY BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES.",
    "Zlib Software License, Version 1.2",
    "Open Software License - Version 3.0",
    "Vovida Software License, Version 1.0",
)

#: Sentences that are no licence, some with its words.
OTHER = (
    "The driver lost his license after the accident and paid a fine.",
    "The version of the story that she told was not the one in the book.",
    "This work is the result of many years in the field.",
    "The museum is free of charge to any person under the age of ten.",
    "The general public was invited to the opening of the new hall.",
    "A copy of the letter was found in the files of the bank.",
    "He used the software to draw the map of the island.",
    "The terms of the contract were read out to the court.",
    "They were under the bridge when the rain began.",
    "The commons is open to the public for the whole year.",
    "In the spring the river is wide and the fields are wet.",
    "An apache is a member of a people of the south west.",
    "The permission of the owner was asked and granted.",
    "To be or not to be, that is the question of the play.",
    "All rights of way in the valley are marked on the map.",
    "It was the first edition, printed with the author at hand.",
    "The clause in the middle of the sentence is not needed.",
    "Use of the lift is at your own risk.",
    "The software is provided to schools every autumn by the city.",
    "This program is broadcast on Sunday evenings, without any music.",
    "You may use the garden and the kitchen as long as you stay.",
    "In no event was the crowd larger than at the harbour.",
    "The file was found in the drawer, and the code was on the wall.",
    "The license of the restaurant was renewed in the spring.",
    "Distributed over the whole country, the plants bloom in May.",
)

#: (notice, family or class) as written in the wild; for the temperature and the bound only.
CALIBRATION = (
    ("This project is released under the MIT License, see the file for details.", "mit"),
    ("Copyright 2019 the authors, licensed under the MIT license.", "mit"),
    ("Our code is Licensed under the Apache License, Version 2.0, as are the models.", "apache-2.0"),
    ("Copyright 2020. Licensed under the Apache License, Version 2.0 (the License).", "apache-2.0"),
    ("Use of this source code is governed by a BSD-style license found here.", "bsd"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted.", "bsd"),
    ("The plugin is licensed under the GNU General Public License, version 3 or later.", "gpl"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("This file is licensed under the GNU Lesser General Public License, version 2.1 or later.", "lgpl"),
    ("The server is licensed under the GNU Affero General Public License, version 3.", "agpl"),
    ("The files are subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("Text and images licensed under CC BY 4.0 unless noted.", "cc-by"),
    ("The article is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("Photographs licensed under CC BY-SA 4.0 by the museum.", "cc-by-sa"),
    ("The data are licensed under CC BY-NC 4.0 for teaching.", "cc-by-nc"),
    ("The maps are licensed under CC BY-ND 4.0 by the office.", "cc-by-nd"),
    ("Available under the CC0 1.0 Universal Public Domain Dedication.", "cc0"),
    ("This is free and unencumbered software released into the public domain by its author.", "unlicense"),
    ("Copyright 2004 by the publisher. All rights reserved.", "reserved"),
    ("Licensed under the Q Public License, version 1.0.", UNKNOWN),
    ("Licensed under the Nethack General Public License.", UNKNOWN),
    ("SPDX-License-Identifier: W3C", UNKNOWN),
    ("Permission to use, copy, and modify this software for any purpose is hereby granted.", UNKNOWN),
    ("This software is provided as-is, without warranty.", UNKNOWN),
    ("Distributed under the terms of the Lucent Public License.", UNKNOWN),
    ("The inspector asked to see the license of the shop.", NONE),
    ("A free copy was sent to every person who had asked for one.", NONE),
    ("Version 2 of the plan was read to the public in the hall.", NONE),
    ("The rights of the tenants were the subject of the letter.", NONE),
    ("They were granted permission to use the old road.", NONE),
    ("The software on the ship was older than the crew.", NONE),
    ("The words are the same, with or without the music.", NONE),
    ("The foundation was published in the paper as an example.", NONE),
)

_ENDS = ".!?:;"
_SIGNS = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c not in _ENDS)
_CUT = "\x00"


def paragraphs(text: str) -> list[str]:
    """What ``_paragraphs`` gives, in plain Python."""
    lines = text.replace(_CUT, " ").split("\n")
    ends = lambda line: line.rstrip(_SIGNS)[-1:] in (*_ENDS,) and line.rstrip(_SIGNS + _ENDS) != ""
    joined = [x + (_CUT if ends(x) or not x.rstrip(" \t\x0b\f\r") else "\n") for x in lines[:-1]]
    return "".join([*joined, lines[-1]]).split(_CUT)


def _paragraphs(lines: Column) -> Column:
    """The lines of a text, without the character 0, joined but where one is blank or ends a
    sentence: its last word is followed by a sentence's sign. Only a line's end is looked at."""

    def joined(line: Column, k: Column) -> Column:
        own = F.rtrim(line, F.lit(_SIGNS))
        ends = F.right(own, F.lit(1)).isin(*_ENDS) & (F.rtrim(own, F.lit(_SIGNS + _ENDS)) != "")
        blank = F.rtrim(line, F.lit(" \t\x0b\f\r")) == ""
        return F.when(k == F.size(lines) - 1, line).otherwise(F.concat(line, F.when(ends | blank, _CUT).otherwise("\n")))

    return F.split(F.array_join(F.transform(lines, joined), ""), _CUT)


def _words(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" or ord(c) > 127 else " " for c in low).split()


def _grams(parts: list[str]) -> set[tuple[str, ...]]:
    return {tuple(parts[i : i + n]) for n in SIZES for i in range(len(parts) - n + 1)}


def _variants(parts: list[str], filler: list[str], rng: random.Random, count: int):
    """The words themselves, then with text around them and up to a tenth left out."""
    yield list(parts)
    for _ in range(count):
        kept = [w for w in parts if len(parts) < 8 or rng.random() > 0.1]
        pad = lambda: [rng.choice(filler) for _ in range(rng.randrange(8))]
        yield pad() + kept + pad()


def _samples(rng: random.Random, count: int) -> tuple[list[set], list[str]]:
    filler = [w for s in OTHER for w in _words(s)]
    legal = [w for ts in TEMPLATES.values() for t in ts for w in _words(t)]
    rows, labels = [], []
    for family, notices in (*TEMPLATES.items(), (UNKNOWN, FOREIGN)):
        for notice in notices:
            for v in _variants(_words(notice), filler, rng, count):
                rows.append(_grams(v))
                labels.append(family)
    for sentence in OTHER:
        for v in _variants(_words(sentence), filler, rng, count):
            rows.append(_grams(v))
            labels.append(NONE)
    for _ in range(40 * count):  # licence words without their order
        rows.append(_grams([rng.choice(legal) for _ in range(rng.randrange(3, 30))]))
        labels.append(NONE)
    return rows, labels


class Classifier:
    """``grams``: gram → weight of each class; ``bias``; ``heat``, the temperature; ``bound``,
    the least probability of a family."""

    def __init__(self, rounds: int = 300, ridge: float = 1e-3):
        self.classes = [*TEMPLATES, UNKNOWN, NONE]
        rng = random.Random(SEED)
        rows, labels = _samples(rng, 12)
        shared = sorted({g for t in (*TEMPLATES.values(), FOREIGN, OTHER) for x in t for g in _grams(_words(x))})
        index = {g: i for i, g in enumerate(shared)}
        x, y = self._matrix(rows, index), np.array([self.classes.index(k) for k in labels])
        one = np.eye(len(self.classes))[y]
        w, b = np.zeros((len(shared), len(self.classes))), np.zeros(len(self.classes))
        weight = 1 / np.bincount(y, minlength=len(self.classes))[y]
        weight *= len(y) / weight.sum()
        mw, mb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(rounds):  # full-batch descent with momentum on the weighted loss
            slope = (self._softmax(x @ w + b) - one) * weight[:, None] / len(y)
            mw = 0.9 * mw + x.T @ slope + ridge * w / len(y)
            mb = 0.9 * mb + slope.sum(axis=0)
            w -= 2.0 * mw
            b -= 2.0 * mb
        self.weights, self.bias, self.shared, self.index = np.round(w, 6), np.round(b, 6), shared, index
        logits = self._matrix([_grams(_words(t)) for t, _ in CALIBRATION], index) @ self.weights + self.bias
        truth = np.array([self.classes.index(k) for _, k in CALIBRATION])
        # smoothed marks, as notices that are all told apart would ask for no temperature at all
        k = len(self.classes)
        marks = np.eye(k)[truth] * (1 - SMOOTHING) + SMOOTHING / k
        loss = lambda t: -(marks * np.log(self._softmax(logits / t) + 1e-12)).sum(axis=1).mean()
        self.heat = min((j / 10 for j in range(5, 101)), key=loss)
        p = self._softmax(logits / self.heat)
        # no notice that is of no family reaches the bound with one
        rivals = p[truth >= len(TEMPLATES), : len(TEMPLATES)].max()
        self.bound = max(0.5, float(np.ceil(100 * rivals) / 100))
        self.calibrated = float((p.argmax(axis=1) == truth).mean())
        if self.bias.argmax() != len(self.classes) - 1:
            raise RuntimeError("a paragraph without known grams must be no licence")
        self.templates = [(f, _grams(_words(t))) for f, ts in TEMPLATES.items() for t in ts]

    @staticmethod
    def _matrix(rows: list[set], index: dict) -> np.ndarray:
        x = np.zeros((len(rows), len(index)))
        for i, grams in enumerate(rows):
            x[i, [index[g] for g in grams if g in index]] = 1
        return x

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def judge(self, text: str) -> tuple[str, str, float, float] | None:
        """(family, likeliest, probability, share) of one paragraph, None if it is no licence:
        what ``findings`` computes, in plain Python."""
        grams = _grams(_words(text))
        rows = [self.index[g] for g in grams if g in self.index]
        p = self._softmax((self.weights[rows].sum(axis=0) + self.bias) / self.heat)
        k = int(p.argmax())
        if self.classes[k] == NONE:
            return None
        share = max((len(t & grams) / len(t) for f, t in self.templates if f == self.classes[k]), default=0.0)
        sure = p[k] >= self.bound and share >= SHARE
        return (self.classes[k] if sure else UNKNOWN, self.classes[k], float(p[k]), share)


@lru_cache(1)
def classifier() -> Classifier:
    return Classifier()


def _vocabulary(spark: SparkSession, model: Classifier) -> DataFrame:
    """(g int, gram array<string>, w array<double>, t array<int>): a constant."""
    rows = [
        {"g": i, "gram": list(g), "w": model.weights[i].tolist(), "t": [k for k, (_, grams) in enumerate(model.templates) if g in grams]}
        for i, g in enumerate(model.shared)
    ]
    schema = "array<struct<g int, gram array<string>, w array<double>, t array<int>>>"
    one = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), schema)).alias("r"))
    return one.select("r.*").withColumn("h", F.xxhash64("gram"))


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, family, likeliest, probability, share), a row for each paragraph
    whose likeliest class is a licence family or "unknown". ``paragraph`` counts from 0."""
    model = classifier()
    first = sorted({g[0] for g in model.shared})
    keys = [F.col("doc_id"), F.xxhash64("text").alias("_x"), F.octet_length("text").alias("_n")]
    lines = docs.select(*keys, F.split(F.translate(F.coalesce("text", F.lit("")), _CUT, " "), "\n").alias("_lines"))
    parts = lines.select("doc_id", "_x", "_n", F.posexplode(_paragraphs(F.col("_lines"))).alias("paragraph", "_text"))
    spots = parts.select("doc_id", "_x", "_n", "paragraph", words(F.col("_text")).alias("_w")).select(
        "doc_id", "_x", "_n", "paragraph", "_w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_w") - 1, F.lit(1)))).alias("_p")
    )
    likely = spots.filter(F.get("_w", F.col("_p") - 1).isin(first))
    sized = likely.select("*", F.explode(F.array(*map(F.lit, SIZES))).alias("_s")).filter(F.col("_p") + F.col("_s") - 1 <= F.size("_w"))
    gram = F.slice("_w", F.col("_p"), F.col("_s"))
    vocabulary = F.broadcast(_vocabulary(docs.sparkSession, model))
    place = ["doc_id", "_x", "_n", "paragraph"]
    # a gram's places are counted, combined before the shuffle: in copies of a row each comes
    # as often as the row stands
    met = (
        sized.withColumn("_h", F.xxhash64(gram))
        .join(vocabulary.select("g", "gram", "h"), F.col("_h") == F.col("h"))
        .filter(gram == F.col("gram"))
        .groupBy(*place, "g", "_p")
        .agg(F.count("*").alias("copies"))
        .repartition(*place)
        .groupBy(*place, "g")
        .agg(F.min("copies").alias("copies"))
        .join(vocabulary.select("g", "w", "t"), "g")
    )
    classes, templates = model.classes, model.templates
    sums = [F.sum(F.get("w", F.lit(k))).alias(f"z{k}") for k in range(len(classes))]
    hits = [F.count_if(F.array_contains("t", k)).alias(f"t{k}") for k in range(len(templates))]
    summed = met.groupBy(*place).agg(F.min("copies").alias("copies"), *sums, *hits)
    logit = [(F.col(f"z{k}") + float(model.bias[k])) / model.heat for k in range(len(classes))]
    best = F.array_max(F.array(*[F.struct(z.alias("z"), F.lit(-k).alias("k")) for k, z in enumerate(logit)]))
    share = F.greatest(*[
        F.when(F.get(F.array(*map(F.lit, classes)), -F.col("best.k")) == f, F.col(f"t{k}") / len(grams)).otherwise(0.0)
        for k, (f, grams) in enumerate(templates)
    ])
    total = sum((F.exp(z - F.col("best.z")) for z in logit), F.lit(0.0))
    scored = summed.withColumn("best", best).filter(F.col("best.k") != -(len(classes) - 1))
    scored = scored.select(
        "doc_id", "paragraph", F.get(F.array(*map(F.lit, classes)), -F.col("best.k")).alias("likeliest"),
        (1 / total).alias("probability"), share.alias("share"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"),
    )
    sure = (F.col("probability") >= model.bound) & (F.col("share") >= SHARE)
    return scored.select("doc_id", "paragraph", F.when(sure, F.col("likeliest")).otherwise(UNKNOWN).alias("family"), "likeliest", "probability", "share")
