"""Operator 5, licence scans by conditional compression.

All of a text is compressed in lines, long ones in short overlapping windows, with all templates together as raw zstandard
dictionary: what becomes much smaller is a candidate, and those near each other make a block. For each template, a block is
cut into overlapping stretches of one and a half times the template's words, which are compressed alone and with the template as
dictionary; the bytes saved, as a share of what the template itself takes, rank templates and stretches, so that neither a
block's length nor other notices in it count. All that save enough are confirmed in that order by the exact wording: words
of stretch and template are aligned, the stretch must have most of the template, and no word that tells licences apart
(names, versions) may differ; numbers of lists don't count. Words of a confirmed notice are used up. The work grows with
the text only.

Defined results: null and empty texts have no findings; very long texts are searched whole; a document has one row per
licence found in it, at its first place; of equal savings the template first in the list counts; repeated rows are each
reported; an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import map_rows

#: Public licence notices, by SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: Words that tell licences apart.
TELLING = frozenset("apache bsd mit isc gnu gpl lgpl agpl lesser affero mozilla mpl cc by nc sa nd cc0 zero noncommercial sharealike noderivatives unlicense 1 2 3 4 0".split())
#: Windows and their step in bytes, the share that the joint dictionary must save of one, and the bytes over which candidates are joined.
WINDOW, STEP, GATE, JOIN = 48, 16, 0.25, 160
#: The least share of a template that a stretch must save, and that its words must have.
LEAST_SAVING, LEAST_COVER = 0.1, 0.8
_WORD = re.compile(r"[a-z]+|[0-9]+")
_END = re.compile(r"[.!?;](?:\s|$)|\n\s*\n")
_LIST = re.compile(r"(?:^|\n)[^\S\n]*(?:[*#/;-]+[^\S\n]*)*\(?([0-9]+)[.)](?=\s)")


def compressor(dictionary: str | None, level: int) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
    if dictionary is None:
        return zstandard.ZstdCompressor(compression_params=params)
    data = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=data)


class Scanner:
    def __init__(self) -> None:
        plain = [" ".join(t.lower().split()) for _, t in TEMPLATES]
        self.joint = compressor("\n".join(plain), 3)
        self.alone, self.given = compressor(None, 3), [compressor(t, 3) for t in plain]
        self.words = [_WORD.findall(t) for t in plain]
        self.empty = len(self.joint.compress(b""))
        none = len(self.alone.compress(b""))
        self.size = [len(self.alone.compress(t.encode())) - none for t in plain]

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Candidate blocks as places in the text: windows that the joint dictionary makes much smaller, near ones together."""
        # case doesn't count; places must stay, so letters whose lower case is longer are left as they are
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        data, width = (low.encode(), 1) if low.isascii() else (low.encode("utf-8", "replace"), 0)
        out, first = [], 0
        for line in data.split(b"\n"):
            for lo in range(0, max(1, len(line) - WINDOW + STEP), STEP) if len(line) > WINDOW + STEP else (0,):
                part = line[lo : lo + WINDOW] if len(line) > WINDOW + STEP else line
                if self.known(part):
                    if out and first + lo <= out[-1][1] + JOIN:
                        out[-1][1] = first + lo + len(part)
                    else:
                        out.append([first + lo, first + lo + len(part)])
            first += len(line) + 1
        if not width and out:  # bytes to code points
            starts = [i for i, c in enumerate(data) if c & 0xC0 != 0x80]
            at = lambda k: _place(starts, k)
            out = [[at(a), at(b)] for a, b in out]
        return [(a, b) for a, b in out]

    def known(self, part: bytes) -> bool:
        """Whether the templates save enough of a window, and more than its own repeats do."""
        size = len(self.joint.compress(part)) - self.empty if len(part) >= 16 else len(part)
        return size <= (1 - GATE) * len(part) and bool(part.strip()) and size <= (1 - GATE) * (len(self.alone.compress(part)) - self.empty)

    @staticmethod
    def whole(text: str, a: int, b: int) -> tuple[int, int]:
        """The place, widened by a window and to whole words."""
        a, b = max(0, a - WINDOW), min(len(text), b + WINDOW)
        while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
        return a, b

    def savings(self, part: str, places: list[tuple[int, int]]) -> list[tuple[float, int, int]]:
        """(share of the template's own size that its dictionary saves, template, first word) of stretches, best first; case and blanks don't count."""
        out = []
        for k, (z, size) in enumerate(zip(self.given, self.size, strict=True)):
            n = len(self.words[k])
            step = max(1, n // 2)
            for lo in range(0, max(1, len(places) - n + step), step):
                data = " ".join(part[places[lo][0] : places[min(len(places), lo + n + step) - 1][1]].lower().split()).encode("utf-8", "surrogatepass")
                saving = (len(self.alone.compress(data)) - len(z.compress(data))) / size
                if saving >= LEAST_SAVING:
                    out.append((saving, k, lo))
        return sorted(out, key=lambda x: (-x[0], x[1], x[2]))

    def differences(self, own: list[str], lists: set[int], ends: set[int], k: int) -> tuple[float, int, list[str], int, int]:
        """Share of the template that the words have, how many differ from the first to the last common one, those of them that tell licences apart, and the common part.

        lists: places of words that number a list; ends: of those that end a sentence.
        """
        goal = self.words[k]
        match = [m for m in SequenceMatcher(None, own, goal, autojunk=False).get_matching_blocks() if m.size]
        # single words far from the rest aren't part of it
        while len(match) > 1 and match[1].a - match[0].a - match[0].size > 4 * match[0].size:
            del match[0]
        while len(match) > 1 and match[-1].a - match[-2].a - match[-2].size > 4 * match[-1].size:
            del match[-1]
        if not match:
            return 0.0, len(goal), [], 0, 0
        first, last = match[0].a, match[-1].a + match[-1].size
        common = sum(m.size for m in match)
        lost, extra, i, j = [], [], first, 0
        for m in match:
            lost += goal[j : m.b]
            extra += [w for n, w in enumerate(own[i : m.a], i) if n not in lists]
            i, j = m.a + m.size, m.b + m.size
        lost += goal[j:]
        # a telling word right beside the common part counts too, in the same sentence: "version 2" for "version 3"
        edge = [own[n] for n, end in ((first - 1, first - 1), (last, last - 1)) if 0 <= n < len(own) and n not in lists and end not in ends]
        inside = last - first - sum(first <= n < last for n in lists)
        return common / max(len(goal), inside), len(lost) + len(extra), [w for w in lost + extra + edge if w in TELLING], first, last

    def find(self, text: str, a: int, b: int) -> list[tuple[int, str, float, float, int]]:
        """(start, licence, saving, cover, differences) of what a block holds, in order; wording is read beyond its ends."""
        a, b = self.whole(text, a, b)
        part, found = text[a:b], []
        places = [m.span() for m in _WORD.finditer(part.lower())] if len(part.lower()) == len(part) else [m.span() for m in re.finditer(r"[A-Za-z]+|[0-9]+", part)]
        if not places:
            return []
        own = [part[x:y].lower() for x, y in places]
        numbers = {m.start(1) for m in _LIST.finditer(part)}
        lists = {n for n, (x, _) in enumerate(places) if x in numbers}
        ends = {n for n, (x, y) in enumerate(zip(places, places[1:], strict=False)) if _END.search(part[x[1] : y[0]])}
        for saving, k, lo in self.savings(part, places):
            hit = self.confirmed(own, lists, ends, k, lo)
            if hit:
                cover, differ, first, last = hit
                found.append((a + places[first][0], TEMPLATES[k][0], saving, cover, differ))
                own[first:last] = [""] * (last - first)
        return sorted(found)

    def confirmed(self, own: list[str], lists: set[int], ends: set[int], k: int, lo: int) -> tuple[float, int, int, int] | None:
        """Cover, differences and place of the template in the words of a stretch, half a template more at either side."""
        n = len(self.words[k])
        lo, hi = max(0, lo - n // 2), min(len(own), lo + 2 * n + 1)
        near = lambda x: {m - lo for m in range(lo, hi) if m in x}
        cover, differ, telling, first, last = self.differences(own[lo:hi], near(lists), near(ends), k)
        return (cover, differ, lo + first, lo + last) if cover >= LEAST_COVER and not telling else None


def _place(starts: list[int], k: int) -> int:
    """The code point at or before a byte's place."""
    from bisect import bisect_right

    return max(0, bisect_right(starts, k) - 1) if k < (starts[-1] if starts else 0) else len(starts)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license, start (code points), saving, cover and n_differences of each licence found in each document."""

    def start():
        scanner = Scanner()

        def step(batch: pa.RecordBatch) -> dict:
            rows = []
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                text, seen = t.as_py() or "", set()
                for a, b in scanner.blocks(text) if text else ():
                    for hit in scanner.find(text, a, b):
                        if hit[1] not in seen:
                            seen.add(hit[1])
                            rows.append((d.as_py(), hit[1], hit[0], *hit[2:]))
            return {n: [r[i] for r in rows] for i, n in enumerate(("doc_id", "license", "start", "saving", "cover", "n_differences"))}

        return step

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, license string, start long, saving double, cover double, n_differences long", start)
