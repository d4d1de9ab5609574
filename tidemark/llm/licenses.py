"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a run of lines up to a blank one; each of its lines is a paragraph of its own too, since many texts have one
line for each. A softmax regression over hashed word uni-, bi- and trigrams, one weight vector for each family and one for
"unknown", gives family probabilities. It is trained here, on licence texts and on statements that name a licence in CARRIERS'
wordings, both cut, wrapped in other words and dated. The unknown class holds statements of OTHERS, licences of no
family here, and of invented ones, words of licences in no order, and a bounded, documented sample of the corpus. A
temperature calibrates the probabilities: it is fitted on wordings, and on other licences as wholes, that a first fit has
not seen. A paragraph is found if some family is likelier than MIN_PROBABILITY, and so are its lines; the lines are
reported, unless the whole holds more of a template of its family than they do, as with a wrapped text. A report is
confirmed if it holds MIN_SIMILARITY of the n-grams of one of the family's templates.

Scanning classifies every paragraph and line of every text in one Arrow pass, without a shuffle. Those without any n-gram of
the training texts have the probabilities of the bias, which are unknown's.

Defined cases: null and empty texts have no paragraph; a line or paragraph of any length is one; of families tied in
probability the first by name counts; repeated rows are reported each; an empty table gives an empty result. Only doc_id and
text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts, table
from tidemark.llm.tokens import PLAIN, Words, encode, mix

BITS = 20
#: The corpus's part of the unknown class: so many pieces, of SAMPLE_WORDS words at most, of so many texts.
SAMPLE_TEXTS = 2_000
SAMPLE_PIECES = 8_000
SAMPLE_WORDS = 60
#: Long paragraphs made of sampled pieces, for the unknown class too.
LONG_PIECES = 600
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.6
_U = np.uint64
_STEP = _U(0xD1342543DE82EF95)

# Names and short marks of licences, by family.
NAMES: dict[str, tuple[str, ...]] = {
    "AGPL": ("GNU Affero General Public License", "Affero GPL", "AGPL", "AGPLv3", "AGPL-3.0", "AGPL-3.0-or-later", "GNU AGPL version 3"),
    "Apache-2.0": ("Apache License", "Apache License, Version 2.0", "Apache Software License", "Apache 2.0", "Apache-2.0", "Apache 2 license", "ASL 2.0"),
    "BSD": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "Simplified BSD License", "Modified BSD License", "BSD-style license"),
    "BSL-1.0": ("Boost Software License", "Boost Software License, Version 1.0", "BSL-1.0"),
    "CC-BY": ("Creative Commons Attribution License", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 Unported", "CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "CC BY"),
    "CC-BY-NC": ("Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution Non Commercial License", "CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC-4.0", "CC BY-NC"),
    "CC-BY-SA": ("Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution Share Alike License", "Creative Commons Attribution-ShareAlike 3.0 Unported", "CC BY-SA 4.0", "CC BY-SA 3.0 Unported", "CC-BY-SA-4.0", "CC BY-SA"),
    "CC0": ("Creative Commons Zero", "CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "CC0-1.0", "CC0"),
    "EPL": ("Eclipse Public License", "Eclipse Public License, Version 2.0", "EPL-2.0", "EPL 1.0", "Eclipse Public License v1.0"),
    "GPL": ("GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GNU GPL v3", "GPL", "GPLv2", "GPLv3", "GPLv3 or later", "GPL v2", "GPL-3.0-or-later", "GPL-2.0-only", "GNU Public License"),
    "ISC": ("ISC License", "ISC", "Internet Systems Consortium License"),
    "LGPL": ("GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "GNU Library General Public License", "LGPL", "LGPLv2.1", "LGPL v2.1", "LGPLv3", "LGPL-2.1-or-later", "LGPL-3.0-only", "GNU LGPL"),
    "MIT": ("MIT License", "MIT", "MIT/Expat License", "Expat License", "MIT-style license", "MIT X11 License"),
    "MPL-2.0": ("Mozilla Public License", "Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "MPL 2.0", "MPL-2.0", "MPL"),
    "Proprietary": ("All rights reserved", "proprietary and confidential", "commercial license agreement"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "Zlib": ("zlib License", "zlib/libpng License", "zlib"),
}

# Wordings of licence texts and notices, a paragraph each, by family.
TEXTS: dict[str, tuple[str, ...]] = {
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to you under the Apache License, Version 2.0",
        "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work",
        "Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "This is an open access article distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "This is an open access article distributed under the terms of the Creative Commons Attribution Non Commercial License, which permits non-commercial use, distribution, and reproduction, provided the original work is properly cited.",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal. http://creativecommons.org/publicdomain/zero/1.0/",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "The MIT License (MIT)",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is Incompatible With Secondary Licenses, as defined by the Mozilla Public License, v. 2.0.",
        "Covered Software is provided under this License on an as is basis, without warranty of any kind, either expressed, implied, or statutory",
    ),
    "Proprietary": (
        "All rights reserved. No part of this work may be reproduced without written permission.",
        "All rights reserved.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No part of this publication may be reproduced, stored in a retrieval system, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ),
}

# How texts state a licence by its name.
CARRIERS = (
    "{}", "License: {}", "Licence {}", "{} license", "SPDX-License-Identifier: {}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.",
    "This work is licensed under the {}.", "This library is licensed under the {}, version 3.", "This project is distributed under the terms of the {}.",
    "The code is available under the {}, see the LICENSE file for details.", "Copyright (c) the authors. {}", "Published under {} by the authors.", "You may use it under the conditions of the {}.",
)

# Licences of no family here.
OTHERS = (
    "European Union Public License", "EUPL-1.2", "Common Development and Distribution License", "CDDL-1.0", "SIL Open Font License", "OFL-1.1", "Artistic License 2.0", "Perl Artistic License",
    "Python Software Foundation License", "PSF-2.0", "Do What The Fuck You Want To Public License", "WTFPL", "Academic Free License", "AFL-3.0", "Open Software License 3.0", "IBM Public License", "PHP License",
    "Microsoft Public License", "MS-PL", "GNU Free Documentation License", "GFDL-1.3", "Open Database License", "ODbL-1.0", "Server Side Public License", "SSPL-1.0", "Business Source License", "BUSL-1.1",
    "Elastic License", "Llama Community License", "OpenRAIL", "Zope Public License", "W3C Software License", "NCSA License", "PostgreSQL License", "Ruby License", "Sleepycat License", "Beerware License", "driving license", "fishing license",
)
FAMILIES = tuple(NAMES)
UNKNOWN = len(FAMILIES)


def grams(w: Words) -> Iterator[tuple[int, np.ndarray]]:
    """For 1, 2 and 3 words: the 64-bit hash of the n-gram that starts at each word, whatever lines it spans."""
    h = w.hash
    yield 1, mix(h)
    for k in (2, 3):
        h = h[: max(0, len(w.hash) - k + 1)] * _STEP + w.hash[k - 1 :]
        yield k, mix(h + _U(k))


def text_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of all uni-, bi- and trigrams inside one text, distinct."""
    w = Words(texts, fold=PLAIN)
    text = w.text_of()
    out = []
    for k, h in grams(w):
        good = text[: len(h)] == text[k - 1 :]
        out.append(np.stack([text[: len(h)][good].astype(_U), h[good]], 1))
    both = np.unique(np.concatenate(out), axis=0)
    return both[:, 0].astype(np.int64), both[:, 1]


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - BITS)).astype(np.int64)


def _templates() -> list[tuple[int, np.ndarray]]:
    """(family, n-grams) of each text and name of two words or more."""
    own = [(f, x) for f, name in enumerate(FAMILIES) for x in (*TEXTS[name], *(n for n in NAMES[name] if len(Words([n.encode()], fold=PLAIN).hash) > 1))]
    text, h = text_grams(encode([x for _, x in own]))
    cuts = np.searchsorted(text, np.arange(len(own) + 1))
    return [(f, h[a:b]) for (f, _), a, b in zip(own, cuts[:-1], cuts[1:], strict=True)]


@dataclass
class Model:
    """Weights by feature (bucket of n-grams, in order) and class, bias by class."""

    features: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def __post_init__(self) -> None:
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[self.features] = np.arange(len(self.features))
        self.templates = _templates()

    def probabilities(self, unit: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """By class, of units 0 to n - 1; (unit, place of a feature) may repeat."""
        width = len(self.features) + 1
        both = np.unique(unit * width + feature)
        unit, feature = both // width, both % width
        logits = np.zeros((n, UNKNOWN + 1)) + self.bias
        if len(unit):
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            logits[unit[first]] += np.add.reduceat(self.weights[feature], first, axis=0)
        return _softmax(logits / self.temperature)

    def classify(self, lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(family or UNKNOWN, calibrated probability, similarity to the family's best template) of each text as one paragraph."""
        text, h = text_grams(lines)
        place = self.place[bucket(h)]
        probability = self.probabilities(text[place >= 0], place[place >= 0].astype(np.int64), len(lines))
        best = probability.argmax(1)
        cuts = np.searchsorted(text, np.arange(len(lines) + 1))
        similarity = [self.similarity(best[i], h[cuts[i] : cuts[i + 1]]) for i in range(len(lines))]
        return best, probability.max(1, initial=0), np.array(similarity)

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, str, float, float]]:
        """(text, first line, lines, family, probability, similarity) of the paragraphs that some family explains best; lines without words don't count."""
        w = Words(texts, fold=PLAIN)
        if not len(w.hash):
            return
        data = b"\n".join(texts) + b"\n"
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        at = np.searchsorted(ends, w.start)  # the line of each word, blank ones counted
        text = w.text_of()
        new = np.concatenate([[True], at[1:] != at[:-1]])
        line = np.cumsum(new) - 1
        first = np.flatnonzero(new)  # by line: its first word
        apart = np.concatenate([[True], (at[first][1:] != at[first][:-1] + 1) | (text[first][1:] != text[first][:-1])])
        block = (np.cumsum(apart) - 1)[line]
        own = {"line": line, "block": block}
        hits: dict[str, list] = {"line": [], "block": []}
        for k, h in grams(w):
            place = self.place[bucket(h)]
            near = np.flatnonzero(place >= 0)
            for name, unit in own.items():
                good = near[unit[near] == unit[near + k - 1]]
                hits[name].append((unit[good], place[good].astype(np.int64)))
        found: dict[str, dict[int, tuple[int, float]]] = {}  # by unit: its family and probability
        for name, parts in hits.items():
            unit, feature = (np.concatenate(x) for x in zip(*parts, strict=True))
            units, unit = np.unique(unit, return_inverse=True)
            p = self.probabilities(unit, feature, len(units))
            best = p.argmax(1)
            good = np.flatnonzero((best != UNKNOWN) & (p.max(1, initial=0) >= MIN_PROBABILITY))
            found[name] = {int(units[g]): (int(best[g]), float(p[g, best[g]])) for g in good}
        stops = np.append(first[1:], len(w.end))
        blocks = np.append(np.flatnonzero(apart), len(first))

        def row(lo: int, hi: int, family: int, probability: float) -> tuple[int, int, int, str, float, float]:
            i = int(text[first[lo]])
            own = text_grams([data[w.start[first[lo]] : w.end[stops[hi - 1] - 1]]])[1]
            return i, lo - int(np.searchsorted(text[first], i)), hi - lo, FAMILIES[family], probability, self.similarity(family, own)

        by_block: dict[int, list] = {}
        for i in sorted(found["line"]):
            by_block.setdefault(int(block[first[i]]), []).append(row(i, i + 1, *found["line"][i]))
        for b in sorted({*by_block, *found["block"]}):
            lines = by_block.get(b, [])
            if b in found["block"] and blocks[b + 1] - blocks[b] > 1:
                whole = row(int(blocks[b]), int(blocks[b + 1]), *found["block"][b])
                if whole[-1] > max((x[-1] for x in lines), default=0.0):
                    yield whole
                    continue
            yield from lines

    def similarity(self, family: int, own: np.ndarray) -> float:
        """The largest share of a template's n-grams that are among own."""
        return max((float(np.isin(t, own).mean()) for f, t in self.templates if f == family), default=0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def wordings(rng: np.random.Generator, filler: list[str]) -> Iterator[tuple[str, int, int]]:
    """(paragraph, class, group): licences' texts and statements, whole, cut and among other words. A group is one wording of one
    family, or one other licence: what a model that has not seen it is judged on.
    """

    def among(words: list[str], most: int = 12) -> str:
        extra = [filler[j] for j in rng.integers(0, len(filler), rng.integers(0, most))] if filler else []
        year = [f"Copyright (c) {rng.integers(1990, 2030)}"] if rng.random() < 0.2 else []
        return " ".join(year + extra[::2] + words + extra[1::2])

    group = 0
    for f, name in enumerate(FAMILIES):
        for text in TEXTS[name]:
            group += 1
            words = text.split()
            for i in range(14):
                cut = rng.integers(0, max(1, len(words) // 3), 2) if i else (0, 0)
                yield among(words[cut[0] : len(words) - cut[1]]) if i % 2 else " ".join(words[cut[0] : len(words) - cut[1]]), f, group
        for carrier in CARRIERS:
            group += 1
            for own in NAMES[name]:
                if carrier != "{}" or " " in own or len(own) > 4:  # a short mark alone says nothing
                    yield carrier.format(own), f, group
                    yield among(carrier.format(own).split()), f, group
    syllables = ["ka", "lo", "mir", "ten", "zu", "bra", "vel", "on", "qui", "sta"]
    for i, other in enumerate((*OTHERS, *(None,) * 40)):
        group += 1
        for carrier in CARRIERS:
            own = other
            if own is None:  # an invented one
                own = "".join(syllables[j] for j in rng.integers(0, 10, 3)).title() + (" License", " Public License", " Software License", "", "-1.0", " Foundation License v2.0")[i % 6]
            yield carrier.format(own), UNKNOWN, group
            yield among(carrier.format(own).split()), UNKNOWN, group
    words = [x for texts in TEXTS.values() for t in texts for x in t.split()] + [x for names in NAMES.values() for t in names for x in t.split()]
    for i in range(900):  # words of licences in no order: single words prove nothing
        group += 1
        yield among([words[j] for j in rng.integers(0, len(words), rng.integers(1, 7))], 20), UNKNOWN, group


def _regress(text: np.ndarray, feature: np.ndarray, width: int, y: np.ndarray, weight: np.ndarray, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax regression by accelerated gradient steps; (text, feature) sorted by text."""
    n, classes = len(y), UNKNOWN + 1
    target = np.eye(classes, dtype=np.float32)[y]
    weight = (weight / weight.sum()).astype(np.float32)
    row = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    by_feature = np.argsort(feature, kind="stable")
    column = np.flatnonzero(np.concatenate([[True], feature[by_feature][1:] != feature[by_feature][:-1]]))

    def times(v: np.ndarray) -> np.ndarray:
        out = np.zeros((n, v.shape[1]), np.float32)
        out[text[row]] = np.add.reduceat(v[feature], row, axis=0)
        return out

    def back(r: np.ndarray) -> np.ndarray:
        out = np.zeros((width, r.shape[1]), np.float32)
        out[feature[by_feature[column]]] = np.add.reduceat(r[text[by_feature]], column, axis=0)
        return out

    top = np.ones((width, 1), np.float32)
    for _ in range(20):  # power iteration: the curvature's bound
        top = back(weight[:, None] * times(top / max(float(np.linalg.norm(top)), 1e-12)))
    step = 1.5 / max(float(np.linalg.norm(top)), 1e-9)
    w, b = np.zeros((width, classes), np.float32), np.zeros(classes, np.float32)
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        error = (target - _softmax(times(v) + c)) * weight[:, None]
        new, new_b = v + step * (back(error) - penalty * v), c + error.sum(0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = float((t - 1) / t_new)  # a NumPy scalar would widen the arrays
        w, v, b, c, t = new, new + pull * (new - w), new_b, new_b + pull * (new_b - b), t_new
    return w, b


def fit(sample: list[str], seed: int = 7, rounds: int = 150, penalty: float = 1e-5) -> Model:
    """sample: pieces of the corpus, for the unknown class. A first fit without a fifth of the groups calibrates the temperature."""
    rng = np.random.default_rng(seed)
    filler = [x for piece in sample for x in piece.split()]
    paragraphs, labels, groups = zip(*wordings(rng, filler), strict=True)
    stated = {" ".join(x.lower().split()) for x in paragraphs}
    # the corpus holds licences too: pieces that name one in a way known here don't teach unknown
    marks = [" ".join(text.lower().split()[:4]) for texts in TEXTS.values() for text in texts] + [n.lower() for names in NAMES.values() for n in names if len(n) > 4]
    sample = [x for x in sample if (plain := " ".join(x.lower().split())) not in stated and not any(m in plain for m in marks)]
    if sample:  # paragraphs of many lines too say nothing of a licence, whatever words of one they hold
        sample += [" ".join(sample[j] for j in rng.integers(0, len(sample), rng.integers(4, 40))) for _ in range(LONG_PIECES)]
    y = np.array([*labels, *[UNKNOWN] * len(sample)])
    groups = np.array([*groups, *range(max(groups) + 1, max(groups) + 1 + len(sample))])
    text, h = text_grams(encode([*paragraphs, *sample]))
    plain = [*(t for texts in TEXTS.values() for t in texts), *(c.format(n) for c in CARRIERS for n in (*OTHERS, *(x for names in NAMES.values() for x in names)))]
    features = np.unique(bucket(text_grams(encode(plain))[1]))  # other n-grams don't speak for a licence or against it
    at = np.minimum(np.searchsorted(features, bucket(h)), len(features) - 1)
    known = features[at] == bucket(h)
    both = np.unique(text[known] * len(features) + at[known])
    text, feature = both // len(features), both % len(features)
    weight = np.where(y == UNKNOWN, (y != UNKNOWN).sum() / (y == UNKNOWN).sum(), 1.0)
    held = rng.permutation(groups.max() + 1)[groups] % 5 == 0
    seen = ~held[text]
    w, b = _regress(text[seen], feature[seen], len(features), y, weight * ~held, rounds, penalty)
    first = Model(features, w, b, 1.0)
    logits = np.log(np.maximum(first.probabilities(text, feature, len(y))[held], 1e-30))
    loss = lambda z: -(weight[held] * np.log(np.maximum(_softmax(logits / z)[np.arange(held.sum()), y[held]], 1e-12))).sum()
    temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    return Model(features, *_regress(text, feature, len(features), y, weight, rounds, penalty), temperature)


def train(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_pieces: int = SAMPLE_PIECES, sample_words: int = SAMPLE_WORDS, seed: int = 7) -> Model:
    """A model whose unknown class has sample_pieces lines of sample_texts texts, both those with the smallest hashes.

    Lines of more than sample_words words are cut into pieces of so many (and 16 bytes for each of them), so every part of a text
    may be drawn and what one task fits on is bounded. Only the weights come to the driver.
    """
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample_texts)
    sample = sample.select(F.col("doc_id").cast("long").alias("sample_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id").eqNullSafe(F.col("sample_id")))

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        pieces = set()
        for t in texts:
            for line in t.split(b"\n"):
                words = line.split()
                pieces |= {b" ".join(words[i : i + sample_words])[: 16 * sample_words] for i in range(0, len(words), sample_words)}
        yield {"piece": pa.array(sorted(x.decode("utf-8", "replace") for x in pieces), pa.string())}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit([x for batch in batches for x in batch.column(0).to_pylist()], seed)
        yield pa.RecordBatch.from_pydict({"features": [model.features.tobytes()], "weights": [model.weights.tobytes()], "bias": [model.bias.tobytes()], "temperature": [model.temperature]})

    few = map_texts(rows, [], "piece string", work).distinct().orderBy(F.xxhash64("piece"), "piece").limit(sample_pieces)
    row = few.mapInArrow(learn, "features binary, weights binary, bias binary, temperature double").first()
    if row is None:
        return fit([], seed)
    return Model(np.frombuffer(row.features, np.int64), np.frombuffer(row.weights, np.float32).reshape(-1, UNKNOWN + 1), np.frombuffer(row.bias, np.float32), row.temperature)


def scan_licenses(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, paragraph (its first line; lines without words don't count), lines, family, probability, similarity and confirmed of each paragraph that states a licence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = {"paragraph": "long", "lines": "long", "family": "string", "probability": "double", "similarity": "double"}
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        text, *columns = zip(*found, strict=True) if (found := list(sent.value.scan(texts))) else ((),) * (1 + len(names))
        yield {"doc_id": batch.column(0).take(pa.array(text, pa.int64())), **{c: pa.array(v, types[names[c]]) for c, v in zip(names, columns, strict=True)}}

    rows = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], "doc_id long, " + ", ".join(f"{c} {t}" for c, t in names.items()), work)
    return rows.withColumn("confirmed", F.col("similarity") >= MIN_SIMILARITY)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs, train(docs))
