"""License scans: templates ranked by how much they shrink the words around a cue, and confirmed by their wording.

The words around each cue word, as many as the longest template can take, are a block; blocks that meet are one. A block's
windows, about as long as a template to both sides of each cue, are compressed as they are and with the template as a zstandard
raw dictionary; the bytes that it saves rank the templates. In that order they are confirmed: a template is aligned word by
word, and a stretch that holds nearly all of its words in order confirms it. Of stretches that overlap, the one of which its
template saves more bytes stays, and of equal ones the better ranked. So a whole text wins over a notice that it contains, and
the name that was meant over one it resembles.

Only a template that lacks more different words in the block than it may miss is not compressed: no stretch could confirm it.
None is given up for saving little.

Defined cases: null, empty and cue-free texts give no rows; each of a block's licenses is a row; line ends, punctuation and the
length of a block do not matter; equal savings go to the template named first; repeated rows give repeated results; other
columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded_batches

# Licenses, headers, notices and headings in their published wording.
_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_SOURCE = ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
TEMPLATES = {
    "MIT": "under the MIT License",
    "MIT-text": _GRANT + ".",
    "MIT-whole": _GRANT + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0": "under the Apache License, Version 2.0",
    "Apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "BSD": _REDISTRIBUTION,
    "BSD-2-Clause-whole": _REDISTRIBUTION + _SOURCE + " " + _WARRANTY,
    "BSD-3-Clause": "under the BSD 3-Clause License",
    "BSD-3-Clause-whole": _REDISTRIBUTION + _SOURCE + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _WARRANTY,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-whole": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "under CC BY 4.0",
    "CC-BY-SA-4.0": "under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "under CC BY-NC 4.0",
    "CC-BY-ND-4.0": "under CC BY-ND 4.0",
    "CC0-1.0": "under CC0 1.0 Universal",
    "CC-BY-4.0-name": "licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-name": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-deed-share": "You are free to: Share - copy and redistribute the material in any medium or format for any purpose, even commercially. Adapt - remix, transform, and build upon the material for any purpose, even commercially. The licensor cannot revoke these freedoms as long as you follow the license terms.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "Proprietary": "All rights reserved.",
}
# words of a cue may stand on two lines with marks of comments between them
CUES = r"(?i)licen[cs]|copyright|permission[^a-z0-9]+(?:is|to[^a-z0-9]+use)|redistribut|spdx|rights[^a-z0-9]+reserved|public[^a-z0-9]+domain|\bcc(?:0|[^a-z0-9]+)by|\bcc0\b|gnu[^a-z0-9]+(?:\w+[^a-z0-9]+)?general[^a-z0-9]+public"
_CUE = re.compile(CUES, re.ASCII)
_WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


_TEMPLATE_WORDS = {name: words(t) for name, t in TEMPLATES.items()}
# wording that tells licenses apart, such as names and versions, is short: one word in ten may be missing
_SLACK = {name: len(t) // 10 for name, t in _TEMPLATE_WORDS.items()}
AROUND = max(len(t) + _SLACK[name] for name, t in _TEMPLATE_WORDS.items())


Block = tuple[list[tuple[str, int, int]], list[tuple[int, int]]]


def blocks(text: str) -> list[Block]:
    """(word, start, end) of the words around cues, in code points, and the words [low, high) of each cue among them; blocks that
    overlap or touch are one."""
    cues = [m.span() for m in _CUE.finditer(text)]
    if not cues:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    ranges: list[tuple[int, int, list[tuple[int, int]]]] = []
    for a, b in cues:
        first, last = bisect_right(ends, a), bisect_left(starts, b)
        low, high = max(first - AROUND, 0), min(last + AROUND, len(spans))
        if ranges and low <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(ranges[-1][1], high), [*ranges[-1][2], (first, last)])
        else:
            ranges.append((low, high, [(first, last)]))
    return [([(text[a:b].lower(), a, b) for a, b in spans[low:high]], [(a - low, b - low) for a, b in of]) for low, high, of in ranges]


@lru_cache(maxsize=1)
def _compressors():
    bare = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    make = lambda **kw: zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(**{"compression_level" if k == "level" else k: v for k, v in bare.items()}), **kw)
    dictionary = lambda t: zstandard.ZstdCompressionDict(" ".join(words(t)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return make(), {name: make(dict_data=dictionary(t)) for name, t in TEMPLATES.items()}


@lru_cache(maxsize=4096)
def _plain(said: str) -> int:
    return len(_compressors()[0].compress(said.encode()))


def saving(said: list[str], name: str) -> int:
    """Bytes of the compressed size of a window that a template saves."""
    data = " ".join(said)
    return _plain(data) - len(_compressors()[1][name].compress(data.encode()))


def ranked(said: list[str], cues: list[tuple[int, int]]) -> list[tuple[int, str]]:
    """(bytes saved, template) of the templates that a block can hold, the most saved first: the best of a template's windows
    counts, of which those that meet are one."""
    here, out = set(said), []
    for name, template in _TEMPLATE_WORDS.items():
        if sum(w not in here for w in template) > _SLACK[name]:
            continue
        reach, windows = len(template) + 2 * _SLACK[name], []
        for a, b in cues:
            low, high = max(a - reach, 0), min(b + reach, len(said))
            if windows and low <= windows[-1][1]:
                windows[-1] = (windows[-1][0], max(high, windows[-1][1]))
            else:
                windows.append((low, high))
        out.append((max(saving(said[a:b], name) for a, b in windows), name))
    return sorted(out, key=lambda x: -x[0])  # equal ones stay in order


def aligned(said: list[str], template: list[str], missing: int, added: int) -> list[tuple[int, int, int, int]]:
    """(start, end, missing, added) of stretches that hold the template's words in order.

    At most ``missing`` words of it are missing, and of the words between the first and the last held at most ``added``
    more than are missing do not belong to it. Of each end and number of missing words the shortest stretch is given.
    """
    places: dict[str, list[int]] = {}
    for i, w in enumerate(template):
        places.setdefault(w, []).append(i)
    n, most = len(template), missing + added
    found, live = [], {}  # live: (words of the template passed, missing of them) -> fewest added; the last state ends here
    for j, word in enumerate(said):
        now = {state: more + 1 for state, more in live.items() if more < most}
        for p in places.get(word, ()):
            # from nothing, or from a state some words before p, which are then missing
            got = {p: 0} if p <= missing else {}
            for gap in range(min(missing, p) + 1):
                for m in range(missing - gap + 1):
                    more = live.get((p - gap, m))
                    if more is not None and more < got.get(m + gap, most + 1):
                        got[m + gap] = more
            for m, more in got.items():
                now[p + 1, m] = min(more, now.get((p + 1, m), most))
                lacking = m + n - p - 1
                if lacking <= missing and more <= lacking + added:
                    found.append((j + m - p - more, j + 1, lacking, more))
        live = now
    return found


def differences(block: list[str], template: list[str]) -> tuple[int, int]:
    """Words of the template that the block lacks, and words that it adds, in the stretch with the fewest of both."""
    best = min(aligned(block, template, len(template), len(block)), key=lambda x: (x[2] + x[3], x[2]), default=None)
    return best[2:] if best else (len(template), 0)


def confirmed(said: list[str], cues: list[tuple[int, int]]) -> list[tuple[int, int, str, int, int, int]]:
    """(start, end, license, saved, missing, added) of the stretches that confirm templates, the most saved first and equal ones
    in order of the ranking; those of one template lie apart."""
    out = []
    for _, name in ranked(said, cues):
        slack = _SLACK[name]
        found = sorted(aligned(said, _TEMPLATE_WORDS[name], slack, slack), key=lambda x: (x[2] + x[3], x[2], x[0]))
        out += [(a, b, name, saving(said[a:b], name), lacking, more) for a, b, lacking, more in apart(found)]
    return sorted(out, key=lambda x: -x[3])


def apart(found: list[tuple]) -> list[tuple]:
    """Of stretches [start, end), best first, those that overlap no better one."""
    kept: list[tuple] = []  # by start
    for x in found:
        k = bisect_left(kept, x[:2], key=lambda y: y[:2])
        if (k == 0 or kept[k - 1][1] <= x[0]) and (k == len(kept) or x[1] <= kept[k][0]):
            kept.insert(k, x)
    return kept


RESULT = "doc_id long, block long, start long, end long, license string, saved long, missing long, added long"


def scan(text: str | None) -> list[tuple]:
    out = []
    for k, (block, cues) in enumerate(blocks(text) if text else []):
        for a, b, name, saved, missing, added in apart(confirmed([w for w, _, _ in block], cues)):
            out.append((k, block[a][1], block[b - 1][2], name, saved, missing, added))
    return out


def find_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, block, start, end, license, bytes saved, and missing and added words of each confirmed stretch."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs[doc_id].cast("string").alias("doc_id"), docs[text].alias("text")).filter(F.col("text").rlike(CUES))

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(d, *x) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for x in scan(t)]
            yield pd.DataFrame(out, columns=["doc_id", "block", "start", "end", "license", "saved", "missing", "added"])

    found = rows.mapInPandas(scanned, RESULT.replace("doc_id long", "doc_id string"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
