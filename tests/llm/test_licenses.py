"""Licenses that look alike, and notices that are reworded, cut and mixed with other words."""

import random

from atalaia.llm import patience


def test_look_alikes_are_told_apart(spark):
    rows = [
        ("Released under the BSD License.", "BSD-notice"),
        ("Licensed under the MIT License.", "MIT-notice"),
        ("Released under the Foo License.", None),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0-notice"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0-notice"),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0-notice"),
        ("Licensed under CC BY-NC 3.0.", None),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-notice"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0-notice"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0-notice"),
        ("Licensed under the Mozilla Public License, Version 2.0.", "MPL-2.0-notice"),
        *[(t, n) for n, t in patience.TEMPLATES.items()],
    ]
    for around in ("", " some words of prose that go on, "):
        df = spark.createDataFrame([(i, around + t + around) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
        assert [(r.doc_id, r.license) for r in patience.scan(df).orderBy("doc_id").collect()] == [(i, n) for i, (_, n) in enumerate(rows)]


SAID = [
    "This project is licensed under the {}.",
    "Copyright (c) 2019 Jane Doe and others. Distributed under the terms of the {}; see the file LICENSE.",
    "All code here, unless stated otherwise, is available under the {} (see COPYING)",
    "## License\n\n{}\n",
    "You may redistribute it as the {} allows",
]
NAMED = {
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 license"],
    "MIT": ["MIT License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v2.0"],
    "GPL-3.0": ["GNU GPL v3", "GNU General Public License v3", "GNU General Public License, version 3", "GPL v3 license"],
    "GPL-2.0": ["GNU GPL v2", "GNU General Public License v2"],
    "LGPL-2.1": ["GNU LGPL v2.1", "GNU Lesser General Public License v2.1"],
    "AGPL-3.0": ["GNU AGPL v3", "GNU Affero General Public License v3"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 license"],
}
SPDX = ["MIT", "Apache-2.0", "ISC", "BSD-3-Clause", "GPL-3.0-or-later", "GPL-2.0-only", "LGPL-2.1-or-later", "MPL-2.0", "CC0-1.0", "CC-BY-4.0"]


def notices():
    """(text, names of the license that is in it): reworded mentions, identifiers, and long texts cut by a tenth or with words put between."""
    r = random.Random(3)
    rows = [(said.format(name), {of, f"{of}-notice"}) for of, names in NAMED.items() for name in names for said in SAID]
    rows += [(f"# SPDX-License-Identifier: {x}\nimport os", {x, f"{x.removesuffix('-or-later').removesuffix('-only')}-notice"}) for x in SPDX]
    for name, text in patience.TEMPLATES.items():
        words = text.split()
        if len(words) > 40:
            rows += [(" ".join(words[: len(words) * 9 // 10]), {name}), (" ".join(words[len(words) // 10 :]), {name})]
            rows += [(" ".join(x for w in words for x in ((w, f"note{r.randrange(99)}") if r.random() < 0.06 else (w,))), {name}) for _ in range(6)]
    return rows


def test_recall_on_reworded_notices(spark):
    rows = notices()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in patience.scan(df).collect()}
    missed = [(t[:80], of, got[i]) for i, (t, of) in enumerate(rows) if got[i] not in of]
    print(len(missed), "of", len(rows), missed)
    assert len(rows) >= 200 and len(missed) <= 0.1 * len(rows)


def test_prose_names_no_license(spark):
    texts = ["He holds a license to drive, version 2.0 of it.", "The apache flew over the license office.", "Attribution 4.0 of the errors", "MIT is in Cambridge.", "CC BY post, 4 0 copies", "GNU is not Unix", "Licensed under CC BY-NC 3.0.", "under the GPL v9", "SPDX-License-Identifier: Foo-1.0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.license for r in patience.scan(df).orderBy("doc_id").collect()] == [None] * len(texts)
