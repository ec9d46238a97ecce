"""License scans by conditional compression.

A text is one sequence of words, whatever its lines, paragraphs and comment marks. A template can only be where a window of its length, with room for
other words, holds enough of its words; running counts over whole batches tell which texts have such windows, so that no text is passed over by its wording. Blocks
are cut around these windows, on a grid for each size of templates. Each block is compressed without a dictionary and with every template as a raw
zstandard dictionary, and the templates are ranked by the bytes that they save: only the first BEST, those level with the last of them included, that save at least
LEAST_SAVED are looked for in the block. There the exact wording confirms: the words of window and template are aligned, and a template is
found only if few of its words are missing and few others stand between them. Differences are returned word by word. Of found ones that overlap the
best stays; between equals, the one that saves more, then the first by name.

A text can give several licences, and one several times. Places are those of the whole lines. Null and empty texts have none, repeated rows the same, an
empty table no rows. Other templates, such as whole bodies, can be given by name (`SPDX identifier/form`) and text; a template of more than LONG
words is aligned once for each run of its windows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, text_slices

# Public licence notices and grants, by SPDX identifier and form.
TEMPLATES = {
    "MIT/notice": "Released under the MIT License.",
    "MIT/grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC/grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "ISC/whole": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-or-later/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "BSD-3-Clause/grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "BSD-2-Clause/grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause/whole": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-2-Clause/whole": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense/notice": "This is free and unencumbered software released into the public domain.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0/notice": "Released under CC0 1.0 into the public domain.",
}
#: Least share of a template's words found, and most other words for each of them.
LEAST_FOUND, MOST_OTHER = 0.85, 0.25
#: Templates that are looked for in a block, and the least share of its compressed bytes that they save.
BEST, LEAST_SAVED = 4, 0.1
LEVEL = 3
#: Words up to which a template's windows are blocks of their own.
SHORT = 32
#: Words from which on a template is aligned once for each run of windows.
LONG = 500
_WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Templates:
    """Templates with their words, dictionaries and windows."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        self.words = [words(texts[n]) for n in self.names]
        self.counts = [Counter(w) for w in self.words]
        self.least = [math.ceil(LEAST_FOUND * len(w)) for w in self.words]
        self.width = [len(w) + math.floor(MOST_OTHER * len(w)) for w in self.words]
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.primed = []
        for own in self.words:
            raw = zstandard.ZstdCompressionDict(" ".join(own).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.primed.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False))
        vocabulary = sorted({w for own in self.words for w in own})
        self.number = {w: i for i, w in enumerate(vocabulary)}
        # For each template which words it has; the last column stands for words that none has.
        self.has = np.zeros((len(self.names), len(vocabulary) + 1), dtype=bool)
        for i, own in enumerate(self.words):
            self.has[i, [self.number[w] for w in own]] = True
        spelled = [w.encode() for w in vocabulary]
        cuts = np.concatenate([[0], np.cumsum([len(w) for w in spelled])]).astype(np.int64)
        hashed = Words(np.frombuffer(b"".join(spelled), np.uint8), cuts).hash
        order = np.argsort(hashed)
        self.hashes, self.of_hash = hashed[order], order

    def numbered(self, block: list[str]) -> np.ndarray:
        return np.fromiter((self.number.get(w, -1) for w in block), dtype=np.int64, count=len(block))

    def starts(self, i: int, numbers: np.ndarray) -> np.ndarray:
        """Where a window of the template begins with one of its words and holds enough of them."""
        member = self.has[i][numbers]
        sums = np.concatenate([[0], np.cumsum(member)])
        ends = np.minimum(np.arange(len(numbers)) + self.width[i], len(numbers))
        return np.flatnonzero(member & (sums[ends] - sums[:-1] >= self.least[i]))

    def saved(self, block: list[str]) -> np.ndarray:
        """For each template the share of the block's compressed bytes that its dictionary saves."""
        data = " ".join(block).encode()
        alone = len(self.plain.compress(data))
        return np.array([1 - len(c.compress(data)) / alone for c in self.primed])


@lru_cache(maxsize=4)
def _prepared(texts: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(dict(texts))


def prepared(texts: dict[str, str] | None = None) -> Templates:
    return _prepared(tuple(sorted((TEMPLATES if texts is None else texts).items())))


def saved(block: list[str], number: int, texts: dict[str, str] | None = None) -> float:
    """The share of the block's compressed bytes that a template's dictionary saves."""
    return float(prepared(texts).saved(block)[number])


def winners(t: Templates, block: list[str]) -> np.ndarray:
    """Which templates save the most of the block's bytes: the first BEST by rank, and others level with the last of these."""
    shares = t.saved(block)
    edge = np.sort(shares)[-min(BEST, len(shares))]
    return (shares >= max(edge, LEAST_SAVED)) & (shares > 0)


def chosen_starts(t: Templates, block: list[str], numbers: np.ndarray) -> dict[int, np.ndarray]:
    """For each template the starts of its windows that lie in blocks where it is among the winners."""
    won: dict[tuple[int, int], np.ndarray] = {}
    out = {}
    for i in range(len(t.names)):
        starts = t.starts(i, numbers)
        if len(starts):
            # Blocks of long templates begin on a grid, those of short ones with each window.
            size = t.width[i] if t.width[i] <= SHORT else 1 << (t.width[i] - 1).bit_length()
            step = 1 if t.width[i] <= SHORT else size // 4
            cells = starts // step
            for cell in np.unique(cells).tolist():
                if (size, cell) not in won:
                    won[size, cell] = winners(t, block[cell * step : cell * step + size + step - 1])
            starts = starts[[won[size, cell][i] for cell in cells.tolist()]]
            if len(starts):
                out[i] = starts
    return out


def differences(block: list[str], template: list[str]) -> tuple[int, list[str], list[str], int, int]:
    """How many of the template's words are found in order, those missing, other words between the first and the last found, and the places of these two."""
    match = SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks()[:-1]
    if not match:
        return 0, template, [], 0, 0
    inside = set()
    found = set()
    for m in match:
        found.update(range(m.a, m.a + m.size))
        inside.update(range(m.b, m.b + m.size))
    first, last = match[0].b, match[-1].b + match[-1].size
    return len(found), [w for i, w in enumerate(template) if i not in found], [block[i] for i in range(first, last) if i not in inside], first, last


def occurrences(t: Templates, text: list[str], starts: np.ndarray, number: int) -> Iterator[tuple]:
    """(key, first, last, missing, other) of each place of a template that begins at one of the starts, least key best; places don't overlap."""
    template, counts, least, width = t.words[number], t.counts[number], t.least[number], t.width[number]
    size = len(template)
    at, best = 0, None
    if size > LONG:
        yield from _long_occurrences(t, text, starts, number)
        return
    for s in starts.tolist():
        if best is not None and s > best[0]:
            yield best[1]
            at, best = best[1][2], None
        if s < at:
            continue
        block = text[s : s + width]
        if (Counter(block) & counts).total() < least:
            continue
        n, missing, other, first, last = differences(block, template)
        if n >= least and len(other) <= MOST_OTHER * size:
            key = (-(n - len(missing) - len(other)) if size > 20 else len(missing) + len(other), -n)
            # A later start, within what may be missing or between, can have a better wording.
            if best is None or key < best[1][0]:
                best = (s + width - least if best is None else best[0], (key, s + first, s + last, missing, other))
            if not missing and not other:
                best = (s, best[1])
    if best is not None:
        yield best[1]


def _long_occurrences(t: Templates, text: list[str], starts: np.ndarray, number: int) -> Iterator[tuple]:
    """The same for long templates, by one alignment for each run of windows that overlap; one of twice the width goes on behind what was found."""
    template, least, width = t.words[number], t.least[number], t.width[number]
    while len(starts):
        s = int(starts[0])
        run = starts[: int(np.searchsorted(starts, s + width - least, side="right"))]
        n, missing, other, first, last = differences(text[s : int(run[-1]) + width], template)
        if n >= least and len(other) <= MOST_OTHER * len(template):
            yield ((-(n - len(missing) - len(other)), -n), s + first, s + last, missing, other)
            starts = starts[starts >= s + last]
        else:
            starts = starts[len(run) :]


def identify(text: str, texts: dict[str, str] | None = None) -> list[dict]:
    """The confirmed licences of a text, by place."""
    t = prepared(texts)
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    block = [text[a:b].lower() for a, b in places]
    found = []
    for i, starts in chosen_starts(t, block, t.numbered(block)).items():
        for key, first, last, missing, other in occurrences(t, block, starts, i):
            found.append((key, -float(t.saved(block[first:last])[i]), first, last, t.names[i], missing, other))
    out, taken = [], np.zeros(len(block), dtype=bool)
    for _, less, first, last, name, missing, other in sorted(found):
        if taken[first:last].any():
            continue
        taken[first:last] = True
        start, end = text.rfind("\n", 0, places[first][0]) + 1, text.find("\n", places[last - 1][1])
        license_, form = name.split("/")
        out.append((first, {"start": start, "end": len(text) if end < 0 else end, "license": license_, "form": form, "saved": round(-less, 4), "missing": missing, "other": other, "exact": not missing and not other}))
    return [o for _, o in sorted(out, key=lambda o: o[0])]


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def with_windows(raw: np.ndarray, offsets: np.ndarray, t: Templates) -> np.ndarray:
    """Which texts of a slice have a window of any template that holds enough of its words."""
    letter = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    solid = letter.copy()
    if len(raw) > 2:
        inner = ((raw[1:-1] == 0x2E) | (raw[1:-1] == 0x2D)) & letter[:-2] & letter[2:] & ~edge[1:-2] & ~edge[2:-1]
        solid[1:-1] |= inner
    found = Words(np.where(solid, raw, np.uint8(0x20)), offsets)
    at = np.minimum(np.searchsorted(t.hashes, found.hash), max(len(t.hashes) - 1, 0))
    numbers = np.where(t.hashes[at] == found.hash, t.of_hash[at], -1) if len(t.hashes) else np.full(len(found.hash), -1)
    out = np.zeros(len(offsets) - 1, dtype=bool)
    last = found.bounds[1:][found.row]
    for i in range(len(t.names)):
        member = t.has[i][numbers]
        sums = np.zeros(len(member) + 1, dtype=np.int32)
        np.cumsum(member, out=sums[1:])
        ends = np.minimum(np.arange(len(member)) + t.width[i], last)
        out[found.row[member & (sums[ends] - sums[:-1] >= t.least[i])]] = True
    return out


FOUND = "start int, end int, license string, form string, saved double, missing array<string>, other array<string>, exact boolean"


def annotate(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """(key, found array<struct<FOUND>>) of every row: its confirmed licences by place, none for most. Places count code points."""
    kind = dict(docs.dtypes)[key]
    fields = [x.split() for x in FOUND.split(", ")]
    types = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    struct = pa.struct([(n, types[t]) for n, t in fields])
    shared = docs.sparkSession.sparkContext.broadcast(texts)  # some licences' texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = prepared(shared.value)
        for part, raw, offsets in text_slices(batches, "t"):
            likely = with_windows(raw, offsets, t)
            found = [identify(raw[a:b].tobytes().decode(), shared.value) if has else [] for has, a, b in zip(likely.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(struct))], ["k", "found"])

    shape = "array<struct<" + ", ".join(f"{n}:{t}" for n, t in fields) + ">>"
    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, found {shape}").withColumnRenamed("k", key)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, FOUND): a row for each confirmed licence of each row."""
    return annotate(docs, key, text).select(key, F.inline("found"))
