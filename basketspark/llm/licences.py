"""Licence scan: windows of words compared to licence templates by the Dice coefficient of their word bigrams."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_texts import TEXTS
from .words import Splitter, mix, odd_numbers

THRESHOLD = 0.8

# fixed values: wording of common licence notices
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_NOTICE = (
    "{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    "{what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
    "of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received "
    "a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
TEMPLATES = {
    "AGPL-3.0-notice": _GNU_NOTICE.format(what="This program", name="Affero General Public License", version="3"),
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License '
        "for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
    "BSD-3-Clause-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-notice": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights "
        "to this software to the public domain worldwide. This software is distributed without any warranty. You should "
        "have received a copy of the CC0 Public Domain Dedication along with this software. If not, see "
        "<http://creativecommons.org/publicdomain/zero/1.0/>."
    ),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        'SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "LGPL-2.1-notice": _GNU_NOTICE.format(what="This library", name="Lesser General Public License", version="2.1"),
    "LGPL-3.0-notice": _GNU_NOTICE.format(what="This program", name="Lesser General Public License", version="3"),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS '
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the "
        "author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to "
        'this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR '
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    **TEXTS,
}


def _bigrams(hashes: np.ndarray) -> np.ndarray:
    f = odd_numbers(2, 47)
    return mix(hashes[:-1] * f[0] + hashes[1:] * f[1])


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Smallest and largest number of bigrams a window can have and still reach ``threshold`` with ``n``."""
    return int(np.ceil(n * threshold / (2 - threshold) - 1e-9)), int(np.floor(n * (2 - threshold) / threshold + 1e-9))


class Scanner:
    """The templates' bags of bigrams and the search for windows of words close to them."""

    def __init__(self, templates: Mapping[str, str], threshold: float):
        self.split, self.threshold = Splitter("letters"), threshold
        self.names, self.bags = [], []
        for name in sorted(templates):
            (words,) = self.split.slices(pa.array([templates[name]]))
            if len(words.hash) > 1:
                self.names.append(name)
                self.bags.append(np.unique(_bigrams(words.hash), return_counts=True))
        self.known = np.unique(np.concatenate([b for b, _ in self.bags])) if self.bags else np.zeros(0, np.uint64)
        self.member = np.array([np.isin(self.known, b) for b, _ in self.bags], np.int32).T
        self.least = np.array([size_bounds(int(n.sum()), threshold)[0] for _, n in self.bags])

    def best(self, bigrams: np.ndarray, line: np.ndarray, bag: tuple) -> tuple[float, int, int, int] | None:
        """(dice, first line, last line, bigrams) of the best window for one template, the earliest if several.

        ``line`` gives each word's line; bigram ``k`` joins words ``k`` and ``k + 1``, also over a line's end. A
        window that begins or ends with a bigram the template lacks is never better than without it.
        """
        own, count = bag
        total = int(count.sum())
        low, high = size_bounds(total, self.threshold)
        place = np.minimum(np.searchsorted(own, bigrams), len(own) - 1)
        at = np.flatnonzero(own[place] == bigrams)
        if len(at) < low:
            return None
        ids = place[at]
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)  # which occurrence of its bigram a hit is
        rank[order] = np.arange(len(ids)) - np.searchsorted(ids[order], ids[order], "left")
        limit = rank - count[ids]  # the hit counts in windows that begin after more than this many of its kind
        stop = np.searchsorted(at, at + high, "left")
        found, before, last = None, np.zeros(len(own), np.int64), 0
        for k in np.flatnonzero(stop - np.arange(len(at)) >= low).tolist():
            size = at[k : stop[k]] - at[k] + 1 + total
            most = 2 * np.minimum(np.arange(1, len(size) + 1), total) / size
            if most.max() < self.threshold or (found is not None and most.max() <= found[0]):
                continue
            before += np.bincount(ids[last:k], minlength=len(own))
            last = k
            dice = 2 * np.cumsum(limit[k : stop[k]] < before[ids[k : stop[k]]]) / size
            m = int(dice.argmax())
            if dice[m] >= self.threshold and (found is None or dice[m] > found[0]):
                found = (float(dice[m]), int(line[at[k]]), int(line[at[k + m] + 1]), int(at[k + m] - at[k] + 1))
        return found

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for w in self.split.slices(batch.column(1)):
                if len(w.hash) < 2 or not self.bags:
                    continue
                bigrams = _bigrams(w.hash)
                place = np.minimum(np.searchsorted(self.known, bigrams), len(self.known) - 1)
                at = np.flatnonzero(self.known[place] == bigrams)
                hits = np.concatenate((np.zeros((1, len(self.bags)), np.int32), np.cumsum(self.member[place[at]], axis=0)))
                breaks = np.concatenate(([0], np.cumsum(w.data == 10)))
                end = np.maximum(w.first[1:] - 1, w.first[:-1])  # the last word of a text opens no bigram
                shared = hits[np.searchsorted(at, end)] - hits[np.searchsorted(at, w.first[:-1])]
                for i, t in np.argwhere(shared >= self.least).tolist():
                    a, b = w.first[i], w.first[i + 1]
                    line = breaks[w.start[a:b]] - breaks[w.edge[i]]
                    got = self.best(bigrams[a : b - 1], line, self.bags[t])
                    if got:
                        rows.append(w.rows[i])
                        out.append((self.names[t], *got))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                names=["doc_id", "licence", "dice", "line_from", "line_to", "n_bigrams"],
            )


def scan_licences(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, licence, dice, line_from, line_to, n_bigrams): the best window of words per row and template.

    Text is normalised to lower-case runs of letters and digits. Windows are all runs of words, on
    one line or several; their bags of bigrams are compared by ``2 * |A & B| / (|A| + |B|)``. The size of a window, or
    what it shares with all templates at most, rules templates out before any bag is built. Lines count from 0.

    Null, empty and one-word texts give no rows, and a template of fewer than two words never matches. Repeated rows
    repeat their results; null ids are carried; other columns are ignored. Nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanner = Scanner(templates, threshold)
    return rows.mapInArrow(
        scanner.run, "doc_id long, licence string, dice double, line_from long, line_to long, n_bigrams long"
    )
