"""License scans by conditional compression: how much shorter is a block once a license text is known?"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices as their licenses word them.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., "
        "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "BSD-disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
        "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. "
        "This software is distributed without any warranty."
    ),
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
}

#: Words that make what stands around them a candidate.
TRIGGER = re.compile(r"licen[sc]|copyright|permission is hereby|redistribut|warrant|free software|creative commons|\bcc by|public domain", re.I)
WORD = re.compile(r"\w+(?:[.\-/]\w+)*")
FOUND = "doc_id bigint, start bigint, end bigint, license string, reduction double, differences int, template_words int"


#: Share of the saving asked for that nominates a template: windows hold other words too, so a place's saving is met there but in part.
NOMINATED = 0.25


class Scanner:
    """Nominates templates of a block by the bytes that knowing them saves, and confirms them by wording and by the saving at their places."""

    def __init__(self, templates: Mapping[str, str], least_reduction: float, most_different: float):
        import zstandard

        self.least, self.most = least_reduction, most_different
        self.words = {k: [w.lower() for w in WORD.findall(v)] for k, v in templates.items()}
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.given = {k: zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(" ".join(v).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, v in self.words.items()}

        self.floor = {k: len(self.plain.compress(" ".join(v).encode())) for k, v in self.words.items()}
        #: no confirmed notice of a template, and of any, has more words
        self.reach = {k: len(v) + int(most_different * len(v)) for k, v in self.words.items()}
        self.longest = max(self.reach.values(), default=0)

    def differences(self, words: list[str], name: str) -> tuple[int, int, int]:
        """Words of the template that are missing, or stand between its words, at its best place: (count, first word, word after the last)."""
        want = self.words[name]
        best = (0, 0, 0)
        kept = start = end = 0
        for b in difflib.SequenceMatcher(None, want, words, autojunk=False).get_matching_blocks()[:-1]:
            # a run of matches goes on as long as they outweigh the words between them
            kept, start = (kept - (b.b - end), start) if kept > b.b - end else (0, b.b)
            kept, end = kept + b.size, b.b + b.size
            best = max(best, (kept, -start, end))
        kept, start, end = best
        return len(want) - kept, -start, end

    def places(self, words: list[str], name: str) -> Iterator[tuple[int, int, int]]:
        """(differences, first word, word after the last) of every confirmed place of a template.

        A place with d differences has a run of matches of a (d + 1)th of the words that agree at least, so it
        is sought around the longest runs, and then in what is left on both sides.
        """
        n = len(self.words[name])
        most = int(self.most * n)
        least = max(1, -(-(n - most) // (most + 1)))
        matcher = difflib.SequenceMatcher(None, self.words[name], words, autojunk=False)
        left = [(0, len(words))]
        while left:
            lo, hi = left.pop()
            run = matcher.find_longest_match(0, n, lo, hi)
            if run.size < least:
                continue
            # where the run stands in the template, or where a phrase that the template repeats could stand
            for before, after in ((run.a + most, n - run.a + most), (n + most, n + most)):
                a = max(lo, run.b - before)
                count, s, e = self.differences(words[a : min(hi, run.b + after)], name)
                if e > s and count <= self.most * n:
                    yield count, a + s, a + e
                    left += [(lo, a + s), (a + e, hi)]
                    break
            else:
                left += [(lo, run.b), (run.b + run.size, hi)]

    def block(self, words: list[str]) -> Iterator[tuple[int, int, str, float, int, int]]:
        """(first word, word after the last, license, reduction, differences, words of the template) for every confirmed license of a block."""
        here = set(words)
        # too many words of a template that the block lacks altogether rule it out
        names = [k for k in self.nominated(words) if sum(w not in here for w in self.words[k]) <= self.most * len(self.words[k])]
        for name in names:
            for count, a, b in self.places(words, name):
                gain, plain = self.saving(words[a:b], name)
                # the saving is held against what the template itself compresses to, or the place if that is shorter
                floor = min(plain, self.floor[name])
                if gain >= self.least * floor:
                    yield a, b, name, gain / floor, count, len(self.words[name])

    def nominated(self, words: list[str]) -> list[str]:
        """Templates that make a window of a block shorter once they are known.

        Windows of a few lengths, shared by templates, overlap by the longest notice that is sought in them: each place is whole in one.
        """
        plain: dict[tuple[int, int], tuple[bytes, int]] = {}

        def shorter(name: str, length: int) -> bool:
            reach = self.reach[name]
            for a in range(0, max(1, len(words) - reach), length - reach + 1):
                if (at := (a, a + length)) not in plain:
                    raw = " ".join(words[a : a + length]).encode()
                    plain[at] = raw, len(self.plain.compress(raw))
                raw, alone = plain[at]
                if alone - len(self.given[name].compress(raw)) >= NOMINATED * self.least * min(alone, self.floor[name]):
                    return True
            return False

        def nominates(name: str) -> bool:
            around = 1 << self.reach[name].bit_length()
            # what a line saves varies by some bytes with the words around it, so at last it has few of them
            return shorter(name, max(96, 2 * around)) or around <= 16 and (shorter(name, 2 * around) or shorter(name, self.reach[name] + 2))

        return [k for k in self.words if nominates(k)]

    def saving(self, words: list[str], name: str) -> tuple[int, int]:
        """Bytes that knowing the template saves, and bytes without it."""
        raw = " ".join(words).encode()
        plain = len(self.plain.compress(raw))
        return plain - len(self.given[name].compress(raw)), plain

    def blocks(self, text: str, starts: list[int]) -> Iterator[tuple[int, int]]:
        """(first word, word after the last) of candidate blocks: as many words on both sides of each trigger as a notice can have.

        Blocks that overlap are one; long ones are passed over in windows that overlap by the longest notice, so that
        blocks stay comparable to templates.
        """
        spans: list[list[int]] = []
        for m in TRIGGER.finditer(text):
            i = bisect_right(starts, m.start()) - 1
            a, b = max(0, i - self.longest), min(len(starts), i + self.longest + 1)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        for a, b in spans:
            for s in range(a, max(a + 1, b - self.longest), 2 * self.longest):
                yield s, min(s + 3 * self.longest, b)

    def text(self, text: str) -> list[tuple[int, int, str, float, int, int]]:
        """The confirmed licenses of a text, offsets in code points; of overlapping ones the one with most words that agree."""
        if not TRIGGER.search(text):
            return []
        at = list(WORD.finditer(text))
        words = [m[0].lower() for m in at]
        found = {(at[a + s].start(), at[a + e - 1].end(), *rest) for a, b in self.blocks(text, [m.start() for m in at]) for s, e, *rest in self.block(words[a:b])}
        kept: list[tuple[int, int, str, float, int, int]] = []
        for x in sorted(found, key=lambda x: (x[4] - x[5], x[4], x[0], x[2], -x[3])):
            if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
                kept.append(x)
        return sorted(kept)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, *, least_reduction: float = 0.3, most_different: float = 0.2) -> DataFrame:
    """Finds license notices in docs (doc_id, text): one row for each, (doc_id, start, end, license, reduction, differences, template_words).

    Candidate blocks hold as many words around each trigger as the longest notice has, however its lines are
    wrapped. Windows of a block are compressed alone and with each template as a raw zstandard dictionary; templates that save
    bytes enough (NOMINATED of least_reduction) are held word by word against the block, at all its places,
    and each place is compressed in both ways too. It is confirmed if the saving
    is at least least_reduction of what it could be and at most most_different of the template's words differ.
    differences 0 is the exact wording. Of notices that overlap the one with most words that agree stays, of equally good ones that with fewer
    differences, then the first by place and name. Null and empty texts have no rows; a null doc_id stays null; repeated rows give
    repeated results; other columns are left out; long texts are gone through in windows; an empty table gives an empty table. Texts are read once and not shuffled.
    """
    templates = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least_reduction, most_different)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
        names = [f.split()[0] for f in FOUND.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                t = text.as_py()
                if t:
                    rows += [(doc_id, *x) for x in scanner.text(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)
