"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Templates are grouped by length. For each group, windows of a fixed number of five-word shingles overlap so that every occurrence lies whole in one of them,
and the number of bands (of one value each) is set so that a window that holds 0.8 of a template's shingles collides with it in some band with a
probability of at least COLLISION. All windows of whole texts are tried; minima of all windows come from doubling, so the cost of a
window does not depend on its length. It is a map over the documents; templates are the library's own, or a given table of at most MOST_TEMPLATES rows.

Defined results: tokens are runs of ASCII letters and digits and of bytes from 0x80, A-Z as a-z; null and empty texts match nothing; a template of fewer than
five tokens is an error; rows are judged one by one, so repeated rows repeat their result; very long texts are scanned whole; overlapping windows that find a template at one
place give one span, from its first to its last matching shingle, in bytes of the text. Of finds that overlap, the one with most matching shingles stays
(then the higher containment, then the name that sorts first), so a notice inside a header, or a license that is nearly another one, gives one license. What tells
licenses apart must stand in the span: a template may name phrases, such as a version, without which it isn't found. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .cluster import keyed, real_id
from .decontaminate import _LETTER, _WORD

WORDS, THRESHOLD, COLLISION = 5, 0.8, 0.9999
GROUPS = ((1, 1), (2, 4), (5, 12), (13, 40), (41, 120), (121, 400), (401, 4000))

MOST_TEMPLATES = 20_000

#: Wordings that several licenses share, as published.
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GPL = "This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."


def _gnu(name: str, version: str) -> str:
    return _GPL.format(name=name, version=version, colon=":" if version[0] == "3" else ";", comma="," if version[0] == "3" else ";")


#: License notices, headers and whole short licenses, as published. Licenses of many pages are known by the header that they prescribe.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "MIT notice": "Released under the MIT License",
    "MIT notice 2": "Licensed under the MIT License",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0 notice 2": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-ND-4.0 notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-NC-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-NC-ND-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-2.0 header": _gnu("General Public License", "2"),
    "GPL-3.0 header": _gnu("General Public License", "3"),
    "LGPL-2.1 header": _gnu("Lesser General Public License", "2.1"),
    "LGPL-3.0 header": _gnu("Lesser General Public License", "3"),
    "AGPL-3.0 header": _gnu("Affero General Public License", "3"),
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-0": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END,
    "BSD-2-Clause": f"{_BSD_START} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD_START} 3. {_BSD_NAMES} {_BSD_END}",
    "BSD-4-Clause": f"{_BSD_START} 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. {_BSD_NAMES} {_BSD_END}",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>',
}
#: What must stand in a span of each license, by the name that its template begins with.
PHRASES = {
    "Apache-2.0": ("Apache License", "Version 2.0"),
    "MIT notice": ("MIT License",),
    "MIT-0": ("to permit persons",),
    "GPL-2.0": ("GNU General Public License", "version 2"),
    "GPL-3.0": ("GNU General Public License", "version 3"),
    "LGPL-2.1": ("GNU Lesser General Public License", "version 2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License", "version 3"),
    "AGPL-3.0": ("GNU Affero General Public License", "version 3"),
    "MPL-2.0": ("Mozilla Public License", "2.0"),
    "BSD-3-Clause": ("endorse or promote products",),
    "BSD-4-Clause": ("advertising materials", "endorse or promote products"),
    "ISC": ("appear in all copies",),
    "CC-BY-4.0": ("Attribution 4.0",),
    "CC-BY-SA-4.0": ("Attribution-ShareAlike 4.0",),
    "CC-BY-NC-4.0": ("NC 4.0", "Attribution-NonCommercial 4.0"),
    "CC-BY-ND-4.0": ("Attribution-NoDerivatives 4.0",),
    "CC-BY-NC-SA-4.0": ("NonCommercial-ShareAlike 4.0",),
    "CC-BY-NC-ND-4.0": ("NonCommercial-NoDerivatives 4.0",),
}


def phrases_of(name: str, text: str) -> tuple[str, ...]:
    """The phrases of the longest name in PHRASES that a template's begins with, of those that its text holds."""
    best = max((k for k in PHRASES if name.startswith(k)), key=len, default=None)
    return tuple(p for p in PHRASES[best] if p in text) if best else ()


def bands_for(similarity: float, rows: int = 1, sure: float = COLLISION) -> int:
    """Least number of bands of so many values with which sets of this similarity share a band with the given probability."""
    return math.ceil(math.log(1 - sure) / math.log(1 - min(similarity, 1 - 1e-9) ** rows))


class Index:
    """MinHash bands of templates, by length group."""

    def __init__(self, templates: dict[str, str], words: int = WORDS, threshold: float = THRESHOLD):
        self.names, self.words, self.threshold = list(templates), words, threshold
        self.sets, self.groups, self.phrases = [], [], []
        for name, text in templates.items():
            h, at = _hashes(text)
            if len(h) < words:
                raise ValueError(f"a template needs {words} tokens: {text!r}")
            self.sets.append(np.unique(bs.shingles(h, at, words)[0]))
            self.phrases.append([_hashes(p)[0] for p in phrases_of(name, text)])
        groups, longest = list(GROUPS), max(map(len, self.sets), default=0)
        while groups[-1][1] < longest:  # a template of any length is in a group
            groups.append((groups[-1][1] + 1, 4 * groups[-1][1]))
        for low, high in groups:
            mine = [t for t, s in enumerate(self.sets) if low <= len(s) <= high]
            if not mine:
                continue
            least, most = min(len(self.sets[t]) for t in mine), max(len(self.sets[t]) for t in mine)
            stride = max(1, least // 2)
            width = most + stride - 1 + (most > 1)
            bands = bands_for(threshold * least / width)
            factor = bs.stream(bands, 41 + low).astype(np.uint32) | np.uint32(1)
            table = np.stack([[(_spread(_low(self.sets[t]), f)).min() for f in factor] for t in mine])
            gate = np.zeros((bands, 1 << 16), bool)
            for b in range(bands):
                gate[b, table[:, b] & 0xFFFF] = True
            self.groups.append((mine, width, stride, factor, table, gate))

    def scan(self, sh: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first and end shingle of a window) for windows of a stream of shingles that collide with a template."""
        found = set()
        low = _low(sh)
        for mine, width, stride, factor, table, gate in self.groups:
            pad = np.full(width - 1, 0xFFFFFFFF, np.uint32)
            for b, f in enumerate(factor):
                least = np.concatenate([_spread(low, f), pad])
                reach = 1
                while reach < width:
                    step = min(reach, width - reach)
                    least = np.minimum(least[: len(least) - step], least[step:])
                    reach += step
                least = least[: len(sh) : stride]
                at = np.flatnonzero(gate[b, least & np.uint32(0xFFFF)])
                if len(at):
                    r, t = np.nonzero(least[at][:, None] == table[:, b][None])
                    found.update(zip((mine[x] for x in t.tolist()), (at[r] * stride).tolist(), strict=True))
        width_of = {t: g[1] for g in self.groups for t in g[0]}
        return [(t, s, s + width_of[t]) for t, s in found]


def _hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    _, h, at = bs.tokens(data, np.array([0, len(data)]), _LETTER)
    return h, at


def _low(sh: np.ndarray) -> np.ndarray:
    return (sh >> np.uint64(32)).astype(np.uint32)


def _spread(x: np.ndarray, f: np.uint32) -> np.ndarray:
    y = x * f
    return y ^ (y >> np.uint32(15))


def template_table(table: DataFrame) -> dict[str, str]:
    """Templates of a table (name, text), at most MOST_TEMPLATES; of a name that repeats, the least text stays. More are an error, not a cut."""
    rows = table.where("name is not null and text is not null").groupBy("name").agg(F.min("text").alias("text")).limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return {r.name: r.text for r in sorted(rows)}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """For each row of docs (_id, _text): _id, matches: array of structs template, start, stop (bytes), containment."""
    index = Index(template_table(templates) if isinstance(templates, DataFrame) else TEMPLATES if templates is None else templates, words, threshold)

    def run(batches):
        for b in batches:
            out: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for row, _, data, at in bs.pieces(b.column("_text"), 1 << 20):
                starts, h, tok = bs.tokens(data, at, _LETTER)
                sh, off = bs.shingles(h, tok, words)
                gaps = np.append(np.flatnonzero(~_WORD[data]), len(data))
                for doc, t, first, last, c in _best(index, _verified(index, sh, off), h, tok, off):
                    stop = min(int(gaps[np.searchsorted(gaps, starts[last])]), int(at[doc + 1]))
                    out[row + doc].append({"template": index.names[t], "start": int(starts[first] - at[doc]), "stop": int(stop - at[doc]), "containment": c})
            for x in out:
                x.sort(key=lambda m: (m["start"], m["stop"], m["template"]))
            kind = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("containment", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(out, kind)], ["_id", "matches"])

    return docs.select("_id", "_text").mapInArrow(run, "_id long, matches array<struct<template:string,start:long,stop:long,containment:double>>")


def _verified(index: Index, sh: np.ndarray, off: np.ndarray) -> dict[tuple, tuple[int, int, float]]:
    """(document, template, first shingle): first and end matching shingle, and exact containment; overlapping finds of a template are one, the best."""
    found: dict[tuple, tuple[int, int, float]] = {}
    for t, s, e in sorted(index.scan(sh)):
        e = min(e, len(sh))
        d = int(np.searchsorted(off, s, "right")) - 1
        while d < len(off) - 1 and off[d] < e:
            x, y = max(s, int(off[d])), min(e, int(off[d + 1]))
            want = index.sets[t]
            near = np.searchsorted(want, sh[x:y])
            hit = x + np.flatnonzero(want[np.minimum(near, len(want) - 1)] == sh[x:y])
            # of several copies in a window, each is a find: the densest stretch that a template with insertions can take, then the rest
            while len(hit) >= index.threshold * len(want) - 1e-9:
                stop = np.searchsorted(hit, hit + int(len(want) / index.threshold) + index.words)
                i = int((stop - np.arange(len(hit))).argmax())
                part = hit[i : stop[i]]
                part = part[: np.unique(sh[part], return_index=True)[1].max() + 1]  # up to the last shingle that is new
                c = len(np.unique(sh[part])) / len(want)
                if c < index.threshold - 1e-9:
                    part = hit
                    c = len(np.unique(sh[part])) / len(want)
                    if c < index.threshold - 1e-9:
                        break
                new = (int(part[0]), int(part[-1]) + 1, c)
                old = next((k for k, v in found.items() if k[0] == d and k[1] == t and v[0] < new[1] and new[0] < v[1]), None) if found else None
                if old is None:
                    found[d, t, new[0]] = new
                elif (c, -(new[1] - new[0])) > (found[old][2], found[old][0] - found[old][1]):
                    found[old] = new
                hit = hit[(hit < part[0]) | (hit > part[-1])]
            d += 1
    return found


def _best(index: Index, found: dict[tuple, tuple[int, int, float]], h: np.ndarray, tok: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(document, template, first and last token, containment) of finds that hold their phrases and overlap no better one."""
    kept: dict[int, list[tuple[int, int, int, int, float]]] = {}
    for (doc, t, _), (s, e, c) in sorted(found.items(), key=lambda x: (-x[1][2] * len(index.sets[x[0][1]]), -x[1][2], index.names[x[0][1]], x[0])):
        first, last = int(tok[doc] + s - off[doc]), int(min(tok[doc] + e - 1 - off[doc] + index.words, tok[doc + 1]) - 1)
        mine = kept.setdefault(doc, [])
        if any(first <= y and x <= last for _, _, x, y, _ in mine):
            continue
        inside = h[first : last + 1]
        if all(_holds(inside, p) for p in index.phrases[t]):
            mine.append((doc, t, first, last, c))
    return [m for mine in kept.values() for m in mine]


def _holds(tokens: np.ndarray, phrase: np.ndarray) -> bool:
    at = np.flatnonzero(tokens[: len(tokens) - len(phrase) + 1] == phrase[0]) if len(tokens) >= len(phrase) else np.zeros(0, int)
    return any((tokens[k : k + len(phrase)] == phrase).all() for k in at.tolist())


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_licenses, spans (template:start:stop, by start) over all documents."""
    out = scan_licenses(keyed(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    spans = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["start"].cast("string"), m["stop"].cast("string"))), ",")
    return out.select(real_id().alias("doc_id"), F.size("matches").cast("long").alias("n_licenses"), spans.alias("spans"))
