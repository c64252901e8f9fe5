"""License scans by patience alignment.

Where a text shares phrases with a license template, the stretch around them is aligned with the template:
equal heads and tails are matched, then words that occur once on both sides are the anchors, of which the
longest increasing subsequence is kept, and the gaps between anchors are aligned in the same way. The share
of the template's words that find a partner is the coverage.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .seeds import Seeds, plain_words
from .suffix import Words

#: License notices and texts; fixed values.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-notice": "Released under the BSD License.",
    "ISC-notice": "Released under the ISC License.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "EPL-2.0-notice": "Licensed under the Eclipse Public License, Version 2.0.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0-notice": "Released under CC0 1.0 Universal.",
    "Unlicense-notice": "Released under the Unlicense.",
    "GPL-2.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
}
#: Words that tell a license from its look-alikes: each phrase must stand in the found stretch with nothing inserted.
NAMED = {
    "Apache-2.0-notice": ["Apache License Version 2.0"],
    "MIT-notice": ["MIT License"],
    "BSD-notice": ["BSD License"],
    "ISC-notice": ["ISC License"],
    "MPL-2.0-notice": ["Mozilla Public License Version 2.0"],
    "EPL-2.0-notice": ["Eclipse Public License Version 2.0"],
    "CC0-1.0-notice": ["CC0 1.0"],
    "Unlicense-notice": ["the Unlicense"],
    "Apache-2.0": ["Apache License Version 2.0"],
    "MPL-2.0": ["Mozilla Public License v 2.0"],
    "BSD-3-Clause": ["neither the name of"],
    **{f"{k}-4.0-notice": [f"{k} 4.0"] for k in ("CC-BY", "CC-BY-SA", "CC-BY-ND", "CC-BY-NC", "CC-BY-NC-SA", "CC-BY-NC-ND")},
    **{f"{k}-notice": [f"GNU {n} License version {k.split('-')[1].removesuffix('.0')}"] for k, n in (("GPL-2.0", "General Public"), ("GPL-3.0", "General Public"), ("LGPL-2.1", "Lesser General Public"), ("LGPL-3.0", "Lesser General Public"), ("AGPL-3.0", "Affero General Public"))},
    **{f"{k}-or-later": [f"GNU {n} License as published", f"version {k.split('-')[1].removesuffix('.0')} of the License"] for k, n in (("GPL-2.0", "General Public"), ("GPL-3.0", "General Public"), ("LGPL-2.1", "Lesser General Public"), ("LGPL-3.0", "Lesser General Public"), ("AGPL-3.0", "Affero General Public"))},
}
#: Names by which texts mention licenses, three words at least, and heads of whole license texts; fixed values.
NAMES = {
    "Apache-2.0": ["Apache License 2.0", "Apache License v2.0", "Apache License, Version 2.0", "Apache Software License 2.0", "Apache 2.0 License", "Apache-2.0 license", "License: Apache-2.0", "under Apache-2.0", "under Apache 2.0"],
    "MIT": ["the MIT License", "License: MIT", "MIT License (MIT)", "(MIT) License", "licensed under MIT", "under MIT license", "MIT-licensed software", "The Expat License"],
    "ISC": ["the ISC License", "License: ISC", "licensed under ISC", "under ISC license"],
    "BSD": ["the BSD License", "a BSD-style license", "licensed under BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "License: BSD-2-Clause", "under BSD-2-Clause", "2-Clause BSD License", "two-clause BSD license"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "License: BSD-3-Clause", "under BSD-3-Clause", "3-Clause BSD License", "three-clause BSD license", "Modified BSD License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License v2.0", "Mozilla Public License, version 2.0", "MPL 2.0 license", "License: MPL-2.0", "under MPL-2.0", "the MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, version 2.0", "License: EPL-2.0", "under EPL-2.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "License: CC0-1.0", "under CC0-1.0"],
    "Unlicense": ["under the Unlicense", "License: Unlicense", "the Unlicense license"],
    **{
        f"{short}-{v}": [f"GNU {name} License {v2}" for v2 in (*([whole] if "." in whole else [f"{whole}.0"]), f"version {whole}", f"v{whole}")]
        + [f"GNU {short} v{whole}", f"GNU {short}, version {whole}", f"{short} v{whole} license", f"License: {short}-{v}", f"License: {short}v{whole}", f"GNU {short}v{whole} license", f"under {short}-{v}", f"under the {short} v{whole}", f"under the {short}v{whole}"]
        for short, name, v in (("GPL", "General Public", "2.0"), ("GPL", "General Public", "3.0"), ("LGPL", "Lesser General Public", "2.1"), ("LGPL", "Lesser General Public", "3.0"), ("AGPL", "Affero General Public", "3.0"))
        for whole in (v.removesuffix(".0"),)
    },
    **{
        f"CC-BY{x}-4.0": [f"CC BY{x} 4.0", f"Creative Commons Attribution{name} 4.0", f"Attribution{name} 4.0 International"]
        for x, name in (("", ""), ("-SA", "-ShareAlike"), ("-ND", "-NoDerivatives"), ("-NC", "-NonCommercial"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))
    },
}
HEADS = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": ["Mozilla Public License Version 2.0 1. Definitions"],
}
#: Endings of SPDX identifiers of the GNU licenses.
GNU_ENDINGS = ("", "-only", "-or-later")


def mentions() -> dict[str, str]:
    """Short templates by license and number (``license-notice:n``): NAMES, HEADS and SPDX identifiers, each to be met word for word."""
    out: dict[str, str] = {}
    for of in sorted({*NAMES, *HEADS}):
        ends = GNU_ENDINGS if of.split("-")[0].endswith("GPL") else ("",)
        spdx = [f"SPDX-License-Identifier: {of}{e}" for e in ends] if of != "BSD" else []
        texts = dict.fromkeys([*NAMES.get(of, []), *HEADS.get(of, []), *spdx])
        out |= {f"{of}-notice:{i}": t for i, t in enumerate(texts, 1)}
    return out


MENTIONS = mentions()
#: Coverage from which a license counts as found, and words of a phrase that starts an alignment.
COVERAGE, SEED = 0.8, 3


def rising(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by piles of cards."""
    tops: list[int] = []
    at: list[int] = []
    back = []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        tops[p : p + 1] = [v]
        at[p : p + 1] = [i]
        back.append(at[p - 1] if p else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """(place in text, place in template) of the words that patience alignment matches, in order.

    A gap that has no word unique to both sides is matched at its head and tail only.
    """
    matched: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        left, right = Counter(text[a:b]), Counter(template[c:d])
        place = {template[i]: i for i in range(c, d) if right[template[i]] == 1}
        anchors = [(i, place[text[i]]) for i in range(a, b) if left[text[i]] == 1 and text[i] in place]
        kept = [anchors[i] for i in rising([j for _, j in anchors])]
        if not kept:
            continue
        matched += kept
        for (i, j), (x, y) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)], strict=True):
            todo.append((i + 1, x, j + 1, y))
    return sorted(matched)


def stands_in(phrase: list, words: list) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def best_alignment(doc: np.ndarray, template: np.ndarray, at: np.ndarray, place: np.ndarray, named: list[list]) -> tuple[float, int, int, bool]:
    """(coverage, first word, word after the last, whether all phrases ``named`` stand in there) of the best alignment of a template near shared phrases.

    ``at`` and ``place`` are where the phrases stand in the document and in the template. Phrases that put the
    template's start within half its length belong to one stretch; each stretch is tried as tight as its phrases put it and
    with room for inserted words. A stretch with the named phrases comes before any without; of equal coverage the first counts.
    """
    n, best, reference = len(template), (0.0, 0, 0, False), template.tolist()
    order = np.sort(at - place)
    i = 0
    while i < len(order):
        j = int(np.searchsorted(order, order[i] + n // 2, "right"))
        low, high, room = int(order[i]), int(order[j - 1]) + n, max(2, n // 4)
        for a, b in dict.fromkeys([(low, low + n), (low, high), (low - room, high + room)]):
            a, b = max(0, a), min(len(doc), b)
            pairs = align(doc[a:b].tolist(), reference)
            share = len(pairs) / n
            if not pairs:
                continue
            first, end = a + pairs[0][0], a + pairs[-1][0] + 1
            whole = all(stands_in(p, doc[first:end].tolist()) for p in named)
            if (whole, share) > (best[3], best[0]):
                best = (share, first, end, whole)
            if best[0] == 1 and best[3]:
                return best
        i = j
    return best


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = COVERAGE) -> DataFrame:
    """One row for each row of (doc_id, text) with the license template its text covers best.

    The templates are TEMPLATES and MENTIONS, unless others are given. Columns: doc_id, license (null where no template reaches ``threshold`` with its NAMED words; of
    equal coverage the longest template, then the first name; a mention has its license's name with -notice), coverage (0 where no phrase of three words is shared), first_word and end_word (the
    stretch of the license's words; null without a license), n_licenses (licenses with a template at the threshold). The
    whole text is scanned. Null text counts as empty; a template of fewer than three words is never found;
    repeated rows stay; other columns are not read.
    """
    prepare(docs.sparkSession)
    known_texts = templates or TEMPLATES | MENTIONS
    names, exact = sorted(known_texts), NAMED | {k: [t] for k, t in MENTIONS.items()}
    texts = [known_texts[n] for n in names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Words()
        known = [w.numbers(plain_words(t)) for t in texts]
        named = [[w.numbers(plain_words(p)).tolist() for p in ([] if templates else exact.get(n, []))] for n in names]
        seeds = Seeds(known, SEED, w)
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                doc = w.numbers(plain_words(t or ""))
                at, which, place = seeds.hits(doc)
                found = [(*best_alignment(doc, known[i], at[which == i], place[which == i], named[i]), i) for i in np.unique(which).tolist()]
                good = [x for x in found if x[0] >= threshold and x[3]]
                share, first, end, _, i = min(good or found, key=lambda x: (-x[0], -len(known[x[4]]), x[4]), default=(0.0, None, None, False, None))
                out.append((names[i].split(":")[0], share, first, end, len({names[x[4]].split(":")[0] for x in good})) if good else (None, share, None, None, 0))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
            arrays = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", "license", "coverage", "first_word", "end_word", "n_licenses"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, license string, coverage double, first_word long, end_word long, n_licenses int")
