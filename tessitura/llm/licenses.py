"""License notices by conditional compression.

Words of which every notice of a template has one at least mark candidate blocks: stretches of words, over line
breaks and comment marks, long enough for the template on either side. A block is compressed alone and with
each template that its words don't rule out as a raw zstandard dictionary, and templates rank by the bytes
that they save. In that order the wording of each is looked for in the block; what stands there in order, but for a few
words, is confirmed with its exact differences. Of templates that claim the same words the one that explains most of
them wins. Places that speak of licenses without such a wording are rows too, unconfirmed, with the template of
the first rank.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .words import text_column

#: Shares of a template's words that a confirmed notice may lack, and have in between.
LACKING, MORE = 0.1, 0.25
#: Bytes, about, of blocks whose compressed sizes a worker keeps, and letters of a block that is kept.
KEEP_BYTES, KEEP_BLOCK = 16 << 20, 1 << 14

#: Cue words, in lower case.
CUES = ("licen", "rights reserved", "copyright", "without warranty", "permission is hereby", "spdx", "public domain")

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(work: str, license: str, version: str) -> str:
    return (
        f"This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {license} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. "
        f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {license} for more details."
    )


#: Notices by license, whole ones and the short forms that stand alone.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": _MIT_GRANT,
    "MIT-text": _MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.",
    "GPL-2.0-header": _gnu("program", "General Public License", "2"),
    "GPL-3.0-header": _gnu("program", "General Public License", "3"),
    "LGPL-2.1-header": _gnu("library", "Lesser General Public License", "2.1"),
    "AGPL-3.0-header": _gnu("program", "Affero General Public License", "3"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD": _BSD_START,
    "BSD-2-Clause": f"{_BSD_START}: {_BSD_CLAUSES} {_BSD_WARRANTY}",
    "BSD-3-Clause": f"{_BSD_START}: {_BSD_CLAUSES} {_BSD_THIRD} {_BSD_WARRANTY}",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated this work to the public domain.",
    "CC0-1.0-text": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "all-rights-reserved": "All rights reserved.",
}
TEMPLATES |= {f"SPDX {name}": f"SPDX-License-Identifier: {name}" for name in ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-only", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0")}

_WORD = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*")
_BREAK = re.compile("\n")


def lowered(text: str) -> str:
    """Lower case, letter for letter."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change length; keep places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


class Wording:
    """The words of a template, and where they stand in others in order."""

    def __init__(self, text: str):
        self.words = _WORD.findall(text.lower())
        n = len(self.words)
        self.count = Counter(self.words)
        self.least, self.most = n - int(LACKING * n), n + int(MORE * n)
        self.masks = self._masks(self.words), self._masks(self.words[::-1])
        #: The longest words, so many that a notice that lacks no more than it may has one of them at least.
        self.needed: list[str] = []
        for word in sorted(self.count, key=lambda w: (-len(w), w)):
            if sum(self.count[w] for w in self.needed) > n - self.least:
                break
            self.needed.append(word)

    @staticmethod
    def _masks(words: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        for k, word in enumerate(words):
            out[word] = out.get(word, 0) | 1 << k
        return out

    def common(self, words: list[str], back: bool = False, enough: int | None = None, first: int = 0, end: int | None = None) -> tuple[int, int]:
        """Length of the longest common subsequence of words[first:end] with the template, and how many of these it takes to reach it, or to reach `enough`.

        One bit of `row` for each word of the template; a bit that falls is a word that the subsequence gains. back: from the ends of both.
        """
        masks, full = self.masks[back], (1 << len(self.words)) - 1
        row, best, at = full, 0, 0
        end = len(words) if end is None else end
        for k, place in enumerate(range(end - 1, first - 1, -1) if back else range(first, end), 1):
            hit = row & masks.get(words[place], 0)
            if hit:
                row = ((row + hit) | (row - hit)) & full
                n = len(self.words) - row.bit_count()
                if n > best:
                    best, at = n, k
                    if enough is not None and n >= enough:
                        break
        return best, at

    def places(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(first, end, common words) of stretches of at most `most` words with at least `least` words of the template in order; they don't overlap."""
        out, at = [], 0
        while len(words) - at >= self.least > 0:
            n, used = self.common(words, enough=self.least, first=at)
            if n < self.least:
                break
            end = at + used
            first = end - self.common(words, back=True, enough=self.least, first=at, end=end)[1]
            if end - first > self.most:
                at = first + 1
                continue
            end = first + self.common(words, first=first, end=min(len(words), first + self.most))[1]
            n, used = self.common(words, back=True, first=max(at, end - self.most), end=end)
            out.append((end - used, end, n))
            at = end
        return out


class Matcher:
    def __init__(self, templates: dict[str, str]):
        self.plain = zstandard.ZstdCompressor(level=12, write_content_size=False, write_checksum=False)
        self.by, self.wordings = {}, {}
        self.anchors = ahocorasick.Automaton()
        owners: dict[str, list[str]] = defaultdict(list)
        for name, text in templates.items():
            wording = Wording(text)
            if not wording.words:
                continue
            self.wordings[name] = wording
            data = zstandard.ZstdCompressionDict(text.lower().encode().ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.by[name] = zstandard.ZstdCompressor(level=12, dict_data=data, write_content_size=False, write_dict_id=False, write_checksum=False)
            for word in wording.needed:
                owners[word].append(name)
        self.owners = dict(owners)
        for word in {*self.owners, *CUES}:
            self.anchors.add_word(word, word)
        self.anchors.make_automaton()
        self.reach = max((w.most for w in self.wordings.values()), default=0)
        self.known: dict[tuple, int] = {}
        self.held = 0

    def saved(self, block: str, name: str | None = None) -> int:
        """Bytes of a block, compressed alone or with a template as dictionary. Those of short blocks are kept, KEEP_BYTES of blocks at most."""
        found = self.known.get((block, name))
        if found is None:
            found = len((self.plain if name is None else self.by[name]).compress(block.encode()))
            if len(block) <= KEEP_BLOCK:
                if self.held > KEEP_BYTES:
                    self.known.clear()
                    self.held = 0
                self.known[block, name] = found
                self.held += 200 + 4 * len(block)
        return found

    def rank(self, block: str, names) -> list[tuple[float, str]]:
        """(share saved, template), best first; the shares are of the block's length when compressed alone."""
        alone = self.saved(block)
        return sorted((((alone - self.saved(block, name)) / alone, name) for name in names), key=lambda x: (-x[0], x[1]))

    def notices(self, low: str, words: list[str], spans: list[tuple[int, int]]) -> list[tuple]:
        """(first word, end, template, share saved, words lacking, words more) of confirmed notices, no word in two of them."""
        places: dict[str, list[int]] = defaultdict(list)
        for k, word in enumerate(words):
            if word in self.owners:
                places[word].append(k)
        hits: dict[str, list[int]] = defaultdict(list)
        for word, at in places.items():
            for name in self.owners[word]:
                hits[name] += at
        # blocks of each template, then blocks of all: stretches in which a notice that holds a needed word must lie
        parts: list[tuple[int, int, str]] = []
        for name, at in hits.items():
            far = self.wordings[name].most
            for k in sorted(at):
                if parts and parts[-1][2] == name and k - far <= parts[-1][1]:
                    parts[-1] = (parts[-1][0], k + far + 1, name)
                else:
                    parts.append((max(0, k - far), k + far + 1, name))
        found = []
        for a, b, names in _merged(parts):
            here = Counter(words[a:b])
            able = [name for name in names if (self.wordings[name].count & here).total() >= self.wordings[name].least]
            if able:
                block = low[spans[a][0] : spans[min(b, len(words)) - 1][1]]
                for share, name in self.rank(block, able):
                    n = len(self.wordings[name].words)
                    found += [(a + x, a + y, name, share, n - c, y - x - c) for x, y, c in self.wordings[name].places(words[a:b])]
        out: list[tuple] = []  # by place, none over another: only the neighbours can be in a row's way
        for row in sorted(found, key=lambda r: (-(len(self.wordings[r[2]].words) - 2 * r[4] - r[5]), -r[3], r[2], r[0])):
            k = bisect_left(out, row[0], key=lambda x: x[0])
            if (k == 0 or out[k - 1][1] <= row[0]) and (k == len(out) or row[1] <= out[k][0]):
                out.insert(k, row)
        return out

    def scan(self, text: str) -> list[tuple]:
        """Rows of a text, by place: start, end, license, share saved, words lacking, words more, exact, confirmed."""
        low = lowered(text)
        cues = [(end - len(word) + 1, end + 1) for end, word in self.anchors.iter(low)]
        if not cues:
            return []
        spans = [m.span() for m in _WORD.finditer(low)]
        words = [low[a:b] for a, b in spans]
        breaks = [m.start() for m in _BREAK.finditer(low)]
        rows = []
        for a, b, name, share, lacking, more in self.notices(low, words, spans):
            rows.append((*_lines(low, breaks, spans[a][0], spans[b - 1][1]), name, share, lacking, more, lacking == more == 0, True))
        return sorted(rows + self.others(low, breaks, words, spans, [r[:2] for r in rows]))

    def others(self, low: str, breaks: list[int], words: list[str], spans: list[tuple[int, int]], sure: list[tuple[int, int]]) -> list[tuple]:
        """Unconfirmed rows: the lines of cues that no confirmed notice stands on, with the template of the first rank."""
        starts, rows, done = [a for a, _ in spans], [], 0
        first, last = [a for a, _ in sure], [b for _, b in sure]  # both rise: notices are in order and cover whole lines
        for cue in CUES:
            at = low.find(cue)
            while at >= 0:
                begin, end = _lines(low, breaks, at, at + len(cue))
                if bisect_left(first, end) <= bisect_right(last, begin):
                    rows.append((begin, end, at))
                at = low.find(cue, at + len(cue))
        out = []
        for begin, end, at in sorted(rows):
            if begin < done:
                continue
            done = end
            k = bisect_left(starts, at)
            a, b = max(0, k - self.reach), min(len(words), k + self.reach)
            block = low[max(begin, spans[a][0]) : min(end, spans[b - 1][1])] if a < b else low[begin:end]
            if not block or not self.by:
                continue
            share, name = self.rank(block, self.by)[0]
            wording, here = self.wordings[name], _WORD.findall(block)
            n = wording.common(here)[0]
            out.append((begin, end, name, share, len(wording.words) - n, len(here) - n, False, False))
        return out


def _lines(low: str, breaks: list[int], first: int, last: int) -> tuple[int, int]:
    """The whole lines of a span; breaks: where lines end."""
    before, after = bisect_left(breaks, first), bisect_left(breaks, last)
    return breaks[before - 1] + 1 if before else 0, breaks[after] if after < len(breaks) else len(low)


def _merged(parts: list[tuple[int, int, str]]) -> list[tuple[int, int, list[str]]]:
    """Stretches that overlap as one, with all their names."""
    out: list[tuple[int, int, list[str]]] = []
    for a, b, name in sorted(parts):
        if out and a < out[-1][1]:
            names = out[-1][2] if name in out[-1][2] else [*out[-1][2], name]
            out[-1] = (out[-1][0], max(b, out[-1][1]), names)
        else:
            out.append((a, b, [name]))
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each notice of a template and for each other line that speaks of licenses: doc_id, start, end (code
    points), license, saved, n_lacking, n_more, exact, confirmed.

    start and end are those of the lines it stands on, which several notices may share. A notice may be wrapped over lines and
    stand behind comment marks; confirmed ones have all but LACKING of a template's words in order and at most MORE of them in
    between (n_lacking, n_more). Of templates that fit the same words the one with most words and fewest differences is the
    row, then the one that saves more, then the first by name. Texts without a cue, empty and null ones give no row,
    an empty table none at all; rows with null or repeated ids give theirs each. Other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        own = Matcher(templates)
        for batch in batches:
            rows = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(doc, *found) for found in own.scan(value.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * 9
            types = pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()
            names = ["doc_id", "start", "end", "license", "saved", "n_lacking", "n_more", "exact", "confirmed"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start int, end int, license string, saved double, n_lacking int, n_more int, exact boolean, confirmed boolean")
