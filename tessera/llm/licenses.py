"""Licence scans: stretches of a text compared with licence templates by the Dice coefficient over word bigrams.

Text and templates are normalised alike: lower-cased words, anything else is a separator. The Dice coefficient of two
bags of bigrams is twice what they share over the sum of their sizes; from its threshold t follow size bounds, t / (2 - t)
and (2 - t) / t times the template's bigrams: a text below the first has no candidate, and no stretch above the second is
compared. Stretches begin and end at bigrams of the template, and only where enough of them are near each other.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W

THRESHOLD = 0.8

#: Licence notices and short licences as they are published.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("LGPL-2.1-or-later", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("LGPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("AGPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("all-rights-reserved", "All rights reserved."),
)


def bigrams(words: np.ndarray) -> np.ndarray:
    return W.mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else np.empty(0, np.uint64)


class Templates:
    """Templates as bags of bigrams, with one sorted table of all their bigrams."""

    def __init__(self, templates, threshold: float):
        self.threshold, self.names = threshold, [n for n, _ in templates]
        self.bags = [Counter(bigrams(W.word_hashes([t])[0]).tolist()) for _, t in templates]
        self.sizes = [sum(b.values()) for b in self.bags]
        self.known = np.array(sorted(set().union(*self.bags)), np.uint64)
        # which templates have each bigram, and how many of a template's a stretch must have
        self.holds = np.array([[int(g) in b for b in self.bags] for g in self.known.tolist()], np.int32).reshape(len(self.known), len(self.bags))
        self.need = np.array([threshold / (2 - threshold) * n if n else np.inf for n in self.sizes])
        self.marks = np.zeros(1 << 16, bool)
        self.marks[(self.known >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Places of the bigrams that some template has."""
        maybe = np.flatnonzero(self.marks[(grams >> np.uint64(48)).astype(np.int64)])
        if not len(maybe) or not len(self.known):
            return maybe[:0]
        k = np.minimum(np.searchsorted(self.known, grams[maybe]), len(self.known) - 1)
        return maybe[self.known[k] == grams[maybe]]

    def best(self, t: int, places: list[int], grams: list[int], total: int) -> tuple[float, int, int] | None:
        """(Dice, first bigram, bigrams) of the stretch most like template ``t``, if it reaches the threshold.

        ``places``: where in the text the known bigrams ``grams`` are; ``total``: bigrams in the text.
        """
        bag, size, least = self.bags[t], self.sizes[t], self.threshold
        if not size or total < least / (2 - least) * size:
            return None
        own = [(p, g) for p, g in zip(places, grams, strict=True) if g in bag]
        most, need = (2 - least) / least * size, least / (2 - least) * size
        best = None
        end = 0
        for a in range(len(own)):
            end = max(end, a)
            while end < len(own) and own[end][0] - own[a][0] < most:
                end += 1
            if end - a < need or best and 2 * (end - a) / (end - a + size) <= best[0]:
                continue
            left, shared = dict(bag), 0
            for b in range(a, end):
                p, g = own[b]
                if left[g]:
                    left[g] -= 1
                    shared += 1
                    length = p - own[a][0] + 1
                    dice = 2 * shared / (length + size)
                    if dice >= least and (best is None or dice > best[0]):
                        best = (dice, own[a][0], length)
        return best


def read_templates(spark: SparkSession, path: str) -> tuple[tuple[str, str], ...]:
    """Templates from a folder of text files, each named by its licence (with or without ``.txt``): full texts, or a list of one's own.

    They go to every task with the query, so a folder of over 64 MB is refused.
    """
    files = spark.read.format("binaryFile").load(path)
    if (size := files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]) > 1 << 26:
        raise ValueError(f"templates of {size} bytes")
    rows = files.select(F.regexp_extract("path", r"([^/]+?)(?:\.txt)?$", 1).alias("name"), F.col("content").cast("string").alias("text")).collect()
    return tuple(sorted((r["name"], r["text"]) for r in rows))


def scan(docs: DataFrame, templates=TEMPLATES, *, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and licence found: ``id``, license, template (its place in the list), dice, start, n_words.

    Of a template's stretches in a text the one of highest Dice is given (ties: the first, shortest). Of a licence's
    templates the best is given. start and n_words count words. Null and empty texts give no row; repeated rows give a row
    each; an empty table or list of templates an empty result. Other columns are not read.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        own = Templates(templates, threshold)
        for batch in batches:
            for part in W.slices(batch, "text"):
                words, bounds = W.word_hashes(part.column("text").to_pylist())
                grams = bigrams(words)
                hits = own.hits(grams)
                doc_of = np.searchsorted(bounds, hits, "right") - 1
                inside = hits + 1 < bounds[doc_of + 1] if len(hits) else np.empty(0, bool)  # not across two texts
                hits, doc_of = hits[inside], doc_of[inside]
                docs_hit, first = np.unique(doc_of, return_index=True)
                rows, ends = [], [*first.tolist(), len(hits)]
                for d, a, b in zip(docs_hit.tolist(), ends[:-1], ends[1:], strict=True):
                    places, values = (hits[a:b] - bounds[d]).tolist(), grams[hits[a:b]].tolist()
                    found: dict[str, tuple] = {}
                    # templates of which the text has too few bigrams, or that are too long for it, are out before any stretch is tried
                    has = own.holds[np.searchsorted(own.known, grams[hits[a:b]])].sum(0)
                    for t in np.flatnonzero((has >= own.need) & (own.need <= bounds[d + 1] - bounds[d] - 1)).tolist():
                        name = own.names[t]
                        if (x := own.best(t, places, values, int(bounds[d + 1] - bounds[d]) - 1)) and (name not in found or x[0] > found[name][1]):
                            found[name] = (t, *x)
                    rows += [(d, name, t, dice, start, n + 1) for name, (t, dice, start, n) in sorted(found.items())]
                ids = part.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
                types = [pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[j + 1] for r in rows], x) for j, x in enumerate(types))], ["id", "license", "template", "dice", "start", "n_words"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, license string, template int, dice double, start long, n_words long").withColumnRenamed("id", id)
