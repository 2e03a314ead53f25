"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Words are runs of letters and digits in lower case, shingles have five words. Templates fall in classes
by their number of shingles, low to 2 * low - 1; a class has windows of a whole number of strides that
is at least the largest template and one stride, so a passage as long as a template lies in a window
whole. If the passage has CONTAINED of the template's shingles, window and template have a Jaccard
similarity of CONTAINED * m / (window + m - CONTAINED * m) at least, j; bands of one row collide with
that probability each, and a class uses so many of them that all miss with probability MISS at most.
A retrieved window counts as a match only if it has CONTAINED of the template's distinct shingles and
the words of NEEDS, which tell versions and relatives apart. Of matches of different licenses that share
most of their shingles in the text, the one with the most distinct shingles counts, then the best contained.

Templates are notices in usual wordings, headers and full bodies. The key of a template is the name that is
reported, with a part after # where a name has several; "or later" has no name of its own. AGPL-3.0 and
EPL are known by their headers and one section each; notices of fewer than five words are not seen.

One row per document, no shuffle; templates are parameters of a fixed size, sent with the function.

Defined results: null or empty text and texts of fewer than five words match nothing; overlapping
matches of one name are one; ties and repeated rows are reported each; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trowel.llm.arrays import PUNCTUATION, U64, mix, slices, text_buffers, tidy, window_owner, windows, words_of
from trowel.llm.license_texts import BODIES
from trowel.session import ship_package

WIDTH, CONTAINED, MISS = 5, 0.8, 1e-3

#: Notices and headers of public licenses, by their SPDX names where these exist.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

#: Warranty disclaimers that several licenses end with.
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT_END = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."


def _gnu_header(work: str, name: str, version: str) -> str:
    return f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."


TEMPLATES |= {
    "GPL-1.0": _gnu_header("program", "GNU General Public License", "1"),
    "GPL-2.0": _gnu_header("program", "GNU General Public License", "2"),
    "LGPL-2.0": _gnu_header("library", "GNU Library General Public License", "2"),
    "LGPL-2.1": _gnu_header("library", "GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu_header("program", "GNU Lesser General Public License", "3"),
    "AGPL-3.0": _gnu_header("program", "GNU Affero General Public License", "3"),
    "GPL-2.0#only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL-3.0#only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    "AGPL-3.0#network": "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software.",
    "BSD-2-Clause#header": TEMPLATES["BSD-2-Clause"] + " " + _BSD_END,
    "BSD-3-Clause": f"{TEMPLATES['BSD-2-Clause']} {_NEITHER}",
    "BSD-3-Clause#body": f"{TEMPLATES['BSD-2-Clause']} {_NEITHER} {_BSD_END}",
    "BSD-4-Clause": f"{TEMPLATES['BSD-2-Clause']} {_ADVERTISING} {_NEITHER}",
    "BSD-4-Clause#body": f"{TEMPLATES['BSD-2-Clause']} {_ADVERTISING} {_NEITHER} {_BSD_END}",
    "MIT-0": TEMPLATES["MIT"].split(", subject to")[0] + ". " + _MIT_END,
    "0BSD": TEMPLATES["ISC"].split(", provided that")[0] + ". " + _ISC_END,
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense#body": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _MIT_END,
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software.",
    "BSL-1.0#header": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "EPL-1.0#body": "Eclipse Public License - v 1.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    "EPL-2.0#body": "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
}
TEMPLATES |= {f"{name}#full": text for name, text in BODIES.items()}

#: Words that a match of a license must have, in or next to its span; a key with # is for that template alone.
NEEDS = {
    "Apache-2.0": ["2 0"],
    "AGPL-3.0": ["GNU Affero General Public License", "version 3"],
    "AGPL-3.0#network": [],
    "Artistic-1.0#full": [],
    "BSD-3-Clause": ["neither the name"],
    "BSD-4-Clause": ["advertising materials mentioning features"],
    "CC-BY-4.0": ["Attribution 4 0"],
    "CC-BY-SA-4.0": ["Attribution ShareAlike 4 0"],
    "EPL-1.0": ["v1 0"],
    "EPL-1.0#body": ["v 1 0"],
    "EPL-2.0": ["2 0"],
    "GFDL-1.2": ["version 1 2"],
    "GFDL-1.3": ["version 1 3"],
    "GPL-1.0": ["GNU General Public License", "version 1"],
    "GPL-2.0": ["GNU General Public License", "version 2"],
    "GPL-3.0": ["GNU General Public License", "version 3"],
    "GPL-3.0#full": ["version 3", "use with the GNU Affero General Public License"],
    "LGPL-2.0": ["Library General Public License", "version 2"],
    "LGPL-2.1": ["Lesser General Public License", "version 2 1"],
    "LGPL-3.0": ["Lesser General Public License", "version 3"],
    "MPL-1.1": ["1 1"],
    "MPL-2.0": ["2 0"],
    "MIT-0": ["furnished to do so the software is provided"],
    "0BSD": ["is hereby granted the software is provided"],
}

#: Names by which notices call a license.
NOTICE_NAMES = {
    "MIT": ["MIT License", "Expat License", "MIT/X11 License"],
    "ISC": ["ISC License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache Software License, Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, version 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License, version 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, version 2.0"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, version 1.0"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "OFL-1.1": ["SIL Open Font License, version 1.1", "SIL Open Font License 1.1"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
}
for _id, _full, _short, _versions in (("GPL", "General Public License", "GPL", "123"), ("LGPL", "Lesser General Public License", "LGPL", ["2.1", "3"]), ("LGPL", "Library General Public License", "LGPL", "2"), ("AGPL", "Affero General Public License", "AGPL", "3")):
    for _v in _versions:
        _names = [f"GNU {_full} {v}{_v}" for v in ("version ", "v")] + ([f"GNU {_short} version {_v}", f"GNU {_short} v{_v}", f"GNU {_short}v{_v}", f"{_short} v{_v}", f"{_short}-{_v}.0" if len(_v) == 1 else f"{_short}-{_v}"] if _full[:3] != "Lib" else [])
        NOTICE_NAMES.setdefault(f"{_id}-{_v if '.' in _v else _v + '.0'}", []).extend(_names)
for _parts, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _v in ("3.0", "4.0"):
        NOTICE_NAMES[f"CC-{_parts}-{_v}"] = [f"Creative Commons {_long} {_v}", f"CC {_parts} {_v}"]


def _notices() -> dict[str, tuple[str, str]]:
    """Key to (template, the name in it), for each name in each usual wording that five words suffice for; none that ends in another."""
    out, seen = {}, set()
    openings = ["under the", "under", "terms of the"] + [f"{verb} under {article}".strip() for verb in ("licensed", "released", "distributed", "available") for article in ("the", "")]
    for licence, names in NOTICE_NAMES.items():
        for name in names:
            for opening in openings:
                raw = np.frombuffer(f"{opening} {name}".encode(), np.uint8)
                words = words_of(raw, np.array([0, len(raw)]), True, separators=PUNCTUATION).hashes
                known = tuple(words.tolist())
                if len(words) < WIDTH or known in seen or any(known[k:] in seen for k in range(1, len(known) - WIDTH + 1)):
                    continue
                seen.add(known)
                out[f"{licence}-notice#{len(out)}"] = (f"{opening} {name}", name)
    return out


_NOTICES = _notices()
TEMPLATES |= {key: text for key, (text, _) in _NOTICES.items()}
NEEDS |= {key: [name] for key, (_, name) in _NOTICES.items()}
NEEDS |= {"GPL-3.0-notice": ["GNU General Public License, version 3"], "Apache-2.0-notice": ["2 0"], "CC-BY-NC-4.0-notice": ["4 0"]}


def name_of(key: str) -> str:
    """The name that is reported for a template."""
    return key.split("#")[0]


def needs_of(key: str) -> list[np.ndarray]:
    """Hashes of the words of each phrase that a match of the template must have."""
    out = []
    for phrase in NEEDS.get(key, NEEDS.get(name_of(key), [])):
        raw = np.frombuffer(phrase.encode(), np.uint8)
        out.append(words_of(raw, np.array([0, len(raw)]), True, separators=PUNCTUATION).hashes)
    return out


def has_phrases(words: np.ndarray, phrases: list[np.ndarray]) -> bool:
    """Are all phrases, as word hashes, runs of words?"""
    return all(len(words) >= len(p) and bool(np.logical_and.reduce([words[k : len(words) - len(p) + 1 + k] == v for k, v in enumerate(p)]).any()) for p in phrases)


def strongest(found: list[tuple[int, str, int, int, float]], h: np.ndarray, templates: dict[str, np.ndarray]) -> list[tuple[int, str, int, int, float]]:
    """(document, name, first, last, containment) without the matches most of whose shingles a stronger match of another license has.

    Overlapping matches of one name become one.
    """
    ranked = []
    for m in found:
        own, part = templates[m[1]], h[m[2] : m[3] + 1]
        hit = m[2] + np.flatnonzero(own[np.minimum(np.searchsorted(own, part), len(own) - 1)] == part)
        ranked.append((m, hit, len(np.unique(h[hit]))))
    ranked.sort(key=lambda r: (r[0][0], -r[2], -r[0][4], r[0][1]))
    taken: list[tuple[int, str, np.ndarray]] = []
    kept: dict[tuple[int, str], list[tuple[int, int, float]]] = {}
    for (doc, key, first, last, share), hit, _ in ranked:
        name = name_of(key)
        licence = name.removesuffix("-notice")
        if any(d == doc and other != licence and 2 * len(np.intersect1d(hit, at, assume_unique=True)) > len(hit) for d, other, at in taken):
            continue
        taken = [t for t in taken if t[0] == doc] + [(doc, licence, hit)]
        kept.setdefault((doc, name), []).append((first, last, share))
    out: list[tuple[int, str, int, int, float]] = []
    for (doc, name), spans in kept.items():
        own: list[tuple[int, str, int, int, float]] = []
        for first, last, share in sorted(spans):
            if own and first <= own[-1][3]:
                before = own.pop()
                first, last, share = before[2], max(before[3], last), max(before[4], share)
            own.append((doc, name, first, last, share))
        out += own
    return out


def template_shingles(templates: dict[str, str], width: int = WIDTH) -> dict[str, np.ndarray]:
    """Sorted distinct shingle hashes of each template of width words or more."""
    out = {}
    for name, text in templates.items():
        raw = np.frombuffer(text.encode(), np.uint8)
        h = np.unique(windows(words_of(raw, np.array([0, len(raw)]), True, separators=PUNCTUATION).hashes, width))
        if len(h):
            out[name] = h
    return out


class Retrieval:
    """MinHash bands of the templates, class by class."""

    def __init__(self, templates: dict[str, np.ndarray], contained: float = CONTAINED, miss: float = MISS) -> None:
        self.classes = []
        lows = sorted({1 << int(math.log2(len(h))) for h in templates.values()})
        for low in lows:
            names = [n for n, h in templates.items() if low <= len(h) < 2 * low]
            stride = max(1, low // 2)
            strides = -(-(2 * low - 1) // stride) + 1
            shared = math.ceil(contained * low)
            j = shared / (strides * stride + low - shared)
            bands = math.ceil(math.log(miss) / math.log(1 - j))
            table = []
            for b in range(bands):
                low_of = np.array([_permuted(templates[n], b).min() for n in names], U64)
                rank = np.argsort(low_of)
                table.append((low_of[rank], rank))
            self.classes.append((stride, strides, names, table, shared))

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[str, int, int]]:
        """(template, first, end) of windows of shingles that collide in a band; bounds: documents in h."""
        found: set[tuple[str, int, int]] = set()
        if not len(h):
            return []
        permuted: dict[int, np.ndarray] = {}
        every = bounds
        for stride, strides, names, table, shared in self.classes:
            # documents with fewer shingles than a match of the class needs are left out
            size = np.diff(every)
            part_of = size >= shared
            own, bounds = h, every
            if not part_of.all():
                own, bounds = h[np.repeat(part_of, size)], np.concatenate(([0], np.cumsum(size[part_of])))
            if not len(own):
                continue
            counts = -(-np.diff(bounds) // stride)
            starts = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])) * stride, counts) + np.arange(counts.sum()) * stride
            ends = np.repeat(bounds[1:], counts)
            ahead = np.repeat(every[:-1][part_of] - bounds[:-1], counts)  # from places in own to places in h
            for b, (lows, rank) in enumerate(table):
                if len(own) == len(h) and b not in permuted:
                    permuted[b] = _permuted(h, b)
                part = np.minimum.reduceat(permuted[b] if len(own) == len(h) else _permuted(own, b), starts)
                least = part.copy()
                for k in range(1, strides):
                    same = ends[k:] == ends[:-k]
                    np.minimum(least[:-k], part[k:], out=least[:-k], where=same)
                at = np.minimum(np.searchsorted(lows, least), len(lows) - 1)
                for w in np.flatnonzero(lows[at] == least).tolist():
                    t = int(at[w])
                    while t < len(lows) and lows[t] == least[w]:
                        found.add((names[rank[t]], int(starts[w] + ahead[w]), int(min(starts[w] + strides * stride, ends[w]) + ahead[w])))
                        t += 1
        return sorted(found)


def _permuted(h: np.ndarray, band: int) -> np.ndarray:
    """One of a family of bijections; its least value over a set is the set's MinHash."""
    odd = int(mix(np.array([band * 2 + 1], U64))[0]) | 1
    x = h * U64(odd)
    return x ^ (x >> U64(29))


def matches_of(h: np.ndarray, bounds: np.ndarray, retrieval: Retrieval, templates: dict[str, np.ndarray], contained: float = CONTAINED) -> list[tuple[int, str, int, int, float]]:
    """(document, template, first shingle, last, containment) with overlapping windows of a template joined."""
    out: list[tuple[int, str, int, int, float]] = []
    for name, first, end in retrieval.candidates(h, bounds):
        own, part = templates[name], h[first:end]
        at = np.minimum(np.searchsorted(own, part), len(own) - 1)
        hit = np.flatnonzero(own[at] == part)
        share = len(np.unique(part[hit])) / len(own)
        if share < contained:
            continue
        doc = int(np.searchsorted(bounds, first, "right")) - 1
        span = (first + int(hit[0]), first + int(hit[-1]))
        if out and out[-1][:2] == (doc, name) and span[0] <= out[-1][3]:
            last = out.pop()
            out.append((doc, name, min(last[2], span[0]), max(last[3], span[1]), max(last[4], share)))
        else:
            out.append((doc, name, *span, share))
    return out


def scanner(templates: dict[str, str], retrieval: Retrieval | None = None):
    """A function for mapInArrow over (doc_id, text)."""
    shingles = template_shingles(templates)
    retrieval = retrieval or Retrieval(shingles)
    needs = {key: needs_of(key) for key in shingles}

    def rows(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            listed: list[list[str]] = [[] for _ in range(batch.num_rows)]
            names: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for i, j in slices(offsets):
                own = offsets[i : j + 1]
                words = words_of(data, own, lower=True, separators=PUNCTUATION)
                h, ok = windows(words.hashes, WIDTH), window_owner(words.bounds, WIDTH, len(words.hashes))
                word = np.flatnonzero(ok)  # first word of each shingle
                bounds = np.searchsorted(word, words.bounds)
                part = data[own[0] : own[-1]]
                found = matches_of(h[ok], bounds, retrieval, shingles)
                if not found:
                    continue
                near = lambda m: words.hashes[max(int(words.bounds[m[0]]), word[m[2]] - WIDTH) : min(int(words.bounds[m[0] + 1]), word[m[3]] + 2 * WIDTH)]  # noqa: B023, E731
                found = strongest([m for m in found if has_phrases(near(m), needs[m[1]])], h[ok], shingles)
                letters = np.flatnonzero(~PUNCTUATION[part])  # bytes of words in the text
                for doc, name, first, last, share in sorted(found, key=lambda m: (m[0], m[2], m[1])):
                    w = word[last] + WIDTH - 1
                    a, b = letters[words.at[word[first]]], letters[words.at[w] + words.size[w] - 1] + 1
                    base = own[doc] - own[0]
                    chars = [int(((part[base:x] & 0xC0) != 0x80).sum()) for x in (a, b)]
                    listed[i + doc].append(f"{name}:{chars[0]}:{chars[1]}:{round(100 * share)}")
                    names[i + doc].add(name)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in listed], pa.int64()), pa.array([",".join(sorted(x)) for x in names], pa.string()), pa.array([",".join(x) for x in listed], pa.string())],
                ["doc_id", "n_matches", "licenses", "spans"],
            )

    return rows


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Per document: doc_id, n_matches, licenses (sorted names) and spans: name:start:end:percent, in code points, end exclusive."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(scanner(templates or TEMPLATES)), "doc_id long, n_matches long, licenses string, spans string")
