"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template is a licence notice or an identifier, as a set of word bigrams; a list is given here, and ``templates_of`` takes
another from a table. Windows of a template's length in bigrams go over a document
at a quarter of that length, so the best window holds at least 7/8 of a copy. ``bands`` bands of ``rows`` min-hashes
each meet with probability 1 - (1 - J**rows)**bands, over ``guarantee`` for the least Jaccard similarity J that a window
of a matching copy can have; a template whose window meets in a band is verified against the exact bigrams of the window
and a stride on either side. A window is only hashed if it holds enough bigrams of a template of that length to verify
at all, which no match can fail, so the skipped windows lose nothing.

Defined results: NULL and empty texts, and texts of one word, have no match. Repeated rows are scanned each, NULL ids are
carried through, extra columns are ignored, long texts are scanned whole. Of several windows with one template the one
of the highest containment is reported, the first of equals (ties); of templates so alike that a copy of one matches the
other, the better one at a place, or both if they are equally good. An empty table has no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .tables import lean

TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": " ".join((
        'Licensed under the Apache License, Version 2.0',
        '(the "License"); you may not use this file',
        'except in compliance with the License. You may',
        'obtain a copy of the License at',
        'http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to',
        'in writing, software distributed under the',
        'License is distributed on an "AS IS" BASIS,',
        'WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,',
        'either express or implied. See the License for',
        'the specific language governing permissions',
        'and limitations under the License.',
    )),
    "MIT": "Released under the MIT License",
    "MIT-licensed": "This software is licensed under the MIT License",
    "MIT-text": " ".join((
        'Permission is hereby granted, free of charge,',
        'to any person obtaining a copy of this',
        'software and associated documentation files',
        '(the "Software"), to deal in the Software',
        'without restriction, including without',
        'limitation the rights to use, copy, modify,',
        'merge, publish, distribute, sublicense, and/or',
        'sell copies of the Software, and to permit',
        'persons to whom the Software is furnished to',
        'do so, subject to the following conditions:',
        'The above copyright notice and this permission',
        'notice shall be included in all copies or',
        'substantial portions of the Software.',
    )),
    "ISC-text": " ".join((
        'Permission to use, copy, modify, and/or',
        'distribute this software for any purpose with',
        'or without fee is hereby granted, provided',
        'that the above copyright notice and this',
        'permission notice appear in all copies.',
    )),
    "BSD-text": " ".join((
        'Redistribution and use in source and binary',
        'forms, with or without modification, are',
        'permitted provided that the following',
        'conditions are met: Redistributions of source',
        'code must retain the above copyright notice,',
        'this list of conditions and the following',
        'disclaimer. Redistributions in binary form',
        'must reproduce the above copyright notice,',
        'this list of conditions and the following',
        'disclaimer in the documentation and/or other',
        'materials provided with the distribution.',
    )),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": " ".join((
        'This program is free software: you can',
        'redistribute it and/or modify it under the',
        'terms of the GNU General Public License as',
        'published by the Free Software Foundation,',
        'either version 3 of the License, or (at your',
        'option) any later version.',
    )),
    "LGPL": "licensed under the GNU Lesser General Public License, version 3",
    "AGPL": "licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MIT-disclaimer": " ".join((
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT',
        'WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,',
        'INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF',
        'MERCHANTABILITY, FITNESS FOR A PARTICULAR',
        'PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL',
        'THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR',
        'ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER',
        'IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,',
        'ARISING FROM, OUT OF OR IN CONNECTION WITH THE',
        'SOFTWARE OR THE USE OR OTHER DEALINGS IN THE',
        'SOFTWARE.',
    )),
    "BSD-disclaimer": " ".join((
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT',
        'HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS',
        'OR IMPLIED WARRANTIES, INCLUDING, BUT NOT',
        'LIMITED TO, THE IMPLIED WARRANTIES OF',
        'MERCHANTABILITY AND FITNESS FOR A PARTICULAR',
        'PURPOSE ARE DISCLAIMED.',
    )),
    "BSD-3-clause": " ".join((
        'Neither the name of the copyright holder nor the',
        'names of its contributors may be used to endorse',
        'or promote products derived from this software',
        'without specific prior written permission.',
    )),
    "Zlib": " ".join((
        "This software is provided 'as-is', without any",
        'express or implied warranty. In no event will',
        'the authors be held liable for any damages',
        'arising from the use of this software.',
        'Permission is granted to anyone to use this',
        'software for any purpose, including commercial',
        'applications, and to alter it and redistribute',
        'it freely, subject to the following',
        'restrictions:',
    )),
    "GPL-2.0-notice": " ".join((
        'This program is free software; you can',
        'redistribute it and/or modify it under the terms',
        'of the GNU General Public License as published',
        'by the Free Software Foundation; either version',
        '2 of the License, or (at your option) any later',
        'version.',
    )),
    "LGPL-notice": " ".join((
        'This library is free software; you can',
        'redistribute it and/or modify it under the terms',
        'of the GNU Lesser General Public License as',
        'published by the Free Software Foundation;',
        'either version 2.1 of the License, or (at your',
        'option) any later version.',
    )),
    "AGPL-notice": " ".join((
        'you can redistribute it and/or modify it under',
        'the terms of the GNU Affero General Public',
        'License as published by the Free Software',
        'Foundation, either version 3 of the License, or',
        '(at your option) any later version.',
    )),
    "EPL-2.0": " ".join((
        'This program and the accompanying materials are',
        'made available under the terms of the Eclipse',
        'Public License 2.0 which is available at',
        'https://www.eclipse.org/legal/epl-2.0/',
    )),
    "BSL-1.0": " ".join((
        'Distributed under the Boost Software License,',
        'Version 1.0. (See accompanying file',
        'LICENSE_1_0.txt or copy at',
        'https://www.boost.org/LICENSE_1_0.txt)',
    )),
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "All-rights-reserved-line": "All rights reserved",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced",
}
#: Identifiers of the SPDX list, as they stand in file headers.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BlueOak-1.0.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 "
    "CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only "
    "LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 UPL-1.0 Unlicense W3C WTFPL Zlib"
).split()
TEMPLATES |= {f"SPDX-{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}


@dataclass(frozen=True)
class LicenseConfig:
    templates: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))
    #: Words of a shingle.
    k: int = 2
    #: Least share of a template's shingles in a match; of an identifier all must be there.
    containment: float = 0.8
    whole: str = "SPDX-"
    bands: int = 40
    rows: int = 2
    guarantee: float = 0.9999

    def least_jaccard(self) -> float:
        """Of the best window of a match: it has 7/8 of the copy's positions, of which ``containment`` are the template's."""
        common = self.containment - 1 / 8
        return common / (2 - common)

    def collision(self, jaccard: float) -> float:
        return 1 - (1 - jaccard**self.rows) ** self.bands


class Templates:
    """Shingles, min-hashes and bands of the templates, by length."""

    def __init__(self, config: LicenseConfig) -> None:
        if config.collision(config.least_jaccard()) < config.guarantee:
            raise ValueError("these bands don't guarantee that a match meets")
        self.config = config
        self.salts = tx.mix(np.arange(1, config.bands * config.rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.names = sorted(config.templates)
        self.sets = []
        for w in tx.hash_words([config.templates[n] for n in self.names]):
            if len(w) < config.k:
                raise ValueError(f"a template needs {config.k} words")
            self.sets.append(np.unique(tx.ngrams(tx.Words(w, np.zeros(len(w), np.int64), w, w), config.k, 1)[0]))
        self.lengths: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            self.lengths.setdefault(len(s), []).append(i)
        self.least = [1.0 if n.startswith(config.whole) else config.containment for n in self.names]
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        #: Templates of which a copy would match this one too, though some of this one isn't in it.
        self.rivals: list[list[int]] = [[] for _ in self.names]
        for i, s in enumerate(self.sets):
            for j, t in enumerate(self.sets):
                common = len(np.intersect1d(s, t, assume_unique=True)) / len(s)
                if i != j and self.least[i] <= common < 1:
                    self.rivals[i].append(j)
        #: For each length, which of the known shingles are in a template of that length.
        self.of_length = {m: np.isin(self.known, np.concatenate([self.sets[i] for i in at])) for m, at in self.lengths.items()}
        self.bands = {m: [self._index(at, b) for b in range(config.bands)] for m, at in self.lengths.items()}

    def minhash(self, shingles: np.ndarray) -> list[bytes]:
        low = tx.mix(shingles[:, None] ^ self.salts[None, :]).min(0).reshape(self.config.bands, self.config.rows)
        return [row.tobytes() for row in low]

    def _index(self, at: list[int], band: int) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        for i in at:
            out.setdefault(self.minhash(self.sets[i])[band], []).append(i)
        return out

    def scan(self, column: pa.Array) -> list[tuple[int, str, float, int]]:
        """(row, template, containment, first word of the window) of all matches."""
        config, out = self.config, []
        for start, _, data, offsets in tx.lower_groups(column):
            w = tx.words(data, offsets)
            k = len(w.hash) - config.k + 1
            if k <= 0 or not len(self.known):
                continue
            g = np.zeros(k, np.uint64)
            for j in range(config.k):
                g += w.hash[j : j + k] * tx._GRAM[j]
            g = tx.mix(g)
            row = np.where(w.row[:k] == w.row[config.k - 1 :], w.row[:k], -1)
            best: dict[tuple[int, int], tuple[float, int]] = {}
            place = np.minimum(np.searchsorted(self.known, g), len(self.known) - 1)
            every = np.flatnonzero((self.known[place] == g) & (row >= 0))
            number = place[every]
            for m, of_length in self.of_length.items():
                hit = every[of_length[number]]
                if not len(hit):
                    continue
                stride = max(1, m // 4)
                least = int(np.ceil(config.containment * m - 1e-9))
                # windows begin at multiples of the stride from the row's start; those that reach a hit
                first = np.searchsorted(w.row, w.row[hit])
                place = (hit - first) // stride
                reach = -(-(m + stride) // stride)
                begins = np.unique(np.concatenate([first + np.maximum(place - d, 0) * stride for d in range(-1, reach + 1)]))
                count = np.searchsorted(hit, begins + m + stride) - np.searchsorted(hit, begins - stride)
                for a in begins[count >= least]:
                    r = int(w.row[a]) if a < len(w.row) else -1
                    window = g[a : a + m][row[a : a + m] == r]
                    if not len(window):
                        continue
                    wide = slice(max(0, a - stride), a + m + stride)
                    held = None
                    for i in {i for b, key in enumerate(self.minhash(window)) for i in self.bands[m][b].get(key, ())}:
                        if held is None:
                            held = np.unique(g[wide][row[wide] == r])
                        share = len(np.intersect1d(held, self.sets[i], assume_unique=True)) / m
                        if share >= self.least[i] - 1e-9 and share > best.get((r, i), (0.0, 0))[0]:
                            best[(r, i)] = (share, int(a - np.searchsorted(w.row, r)))
            for (r, i), (s, a) in sorted(best.items()):
                others = [best[r, j] for j in self.rivals[i] if (r, j) in best]
                if not any(x > s and abs(b - a) <= 2 * len(self.sets[i]) for x, b in others):
                    out.append((r + start, self.names[i], s, a))
        return out


def templates_of(table: DataFrame) -> dict[str, str]:
    """Templates of a table (license, text), as it has them: a list that one keeps beside the corpus, so it fits the driver and
    every task. Rows with a NULL are left out; of a repeated name the least text counts."""
    rows = table.select("license", "text").dropna().groupBy("license").agg(F.min("text").alias("text")).collect()
    return {r.license: r.text for r in rows}


def license_scan(docs: DataFrame, config: LicenseConfig | None = None) -> DataFrame:
    """doc_id, license, containment, start_word: one row for each document and template that match."""
    config = config or LicenseConfig()
    templates = Templates(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = templates.scan(batch.column("text"))
            if found:
                row, name, share, at = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(name), pa.array(share, pa.float64()), pa.array(at, pa.int32())], names=["doc_id", "license", "containment", "start_word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, license string, containment double, start_word int")
