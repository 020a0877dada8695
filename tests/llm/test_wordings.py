"""Licence notices in words that aren't in the module, and prose that only sounds like them."""

from lectern.llm import licences
from lectern.llm.queries import table

NOTICES = {
    "mit": ("Distributed under the MIT licence.", "MIT License Copyright (c) 2020 Jane", "You may use it under the terms of the MIT License", "our library is MIT licensed; see the MIT license text"),
    "apache": ("This software is made available under the terms of the Apache License 2.0", "It ships under the Apache License, version 2", "Apache License Version 2.0, January 2004"),
    "gpl": ("The code is free software under version 2 of the GNU General Public License", "covered by the GNU General Public License as it was published", "We publish it under the GNU GPL"),
    "lgpl": ("You can link with it under the GNU Lesser General Public License",),
    "bsd": ("It has a BSD license like the kernel", "Provided under the 3-clause BSD License by its authors"),
    "mpl": ("Files here follow the Mozilla Public License 2.0",),
    "agpl": ("GNU Affero General Public License v3", "Served under the GNU AGPL by us"),
    "isc": ("SPDX-License-Identifier: ISC", "It comes with the ISC license"),
    "epl": ("Plugins follow the Eclipse Public License 2.0",),
    "zlib": ("The decoder has the zlib license",),
    "public-domain": ("// This file is placed in the public domain.",),
    "cc-by": ("Available under a Creative Commons Attribution 4.0 licence", "Photos: CC BY 4.0, by the museum"),
    "cc-by-nc": ("Photos: CC BY-NC 4.0, by the museum", "shared with a Creative Commons Attribution-NonCommercial 4.0 licence"),
}
PROSE = (
    "The licence of the driver was taken away by the police.", "MIT and other schools license their patents.", "The general public was admitted at noon.",
    "An Apache helicopter landed near the old version of the bridge.", "She was granted permission to use the software at home.", "Creative people share common attribution habits.",
    "He reserved all seats on the right.", "The Mozilla browser was released to the public.", "A source code form is subject to review.", "They redistributed the land and used the forms.",
    "The apache tribe had no general public license to hunt", "He studied at MIT. License fees were paid.", "BSD license plates", "The zlib author met the Eclipse team in public.",
    "An ISC chip has no licence on it.", "Under the law any licence may be revoked.",
)


def test_wordings_kept_out_of_the_module(spark):
    told = ("SPDX-License-Identifier: ISC", "// This file is placed in the public domain.")
    assert not {n for own in NOTICES.values() for n in own if n not in told} & {w for f in licences.FAMILIES for w in licences.wordings(f)}
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    rows = [(family, n) for family, own in NOTICES.items() for n in own] + [(None, p) for p in PROSE]
    frame = docs.unionByName(spark.createDataFrame([(10_000 + i, f"some words before\n{n}\nand after") for i, (_, n) in enumerate(rows)], docs.schema))
    got = {r["doc_id"]: r["families"] for r in licences.scan_licences(frame).where("doc_id >= 10000").collect()}
    caught = [got[10_000 + i] == [f] for i, (f, _) in enumerate(rows) if f]
    clean = [got[10_000 + i] == [] for i, (f, _) in enumerate(rows) if not f]
    assert sum(caught) >= 0.85 * len(caught), [r for i, r in enumerate(rows) if r[0] and got[10_000 + i] != [r[0]]]
    assert all(clean), [r for i, r in enumerate(rows) if not r[0] and got[10_000 + i]]


def test_the_classifier_names_and_templates_confirm():
    """A template alone reports nothing, and neither does a family that its templates don't confirm."""
    import numpy as np

    pairs = licences.template_pairs()
    mit, gpl = licences.FAMILIES.index("mit"), licences.FAMILIES.index("gpl")
    own = licences.word_features([b"Licensed under the MIT License"])[3]
    assert licences.confirmed(own, pairs, 0.6, [mit, gpl])[0] == mit
    assert licences.confirmed(own, pairs, 0.6, [gpl]) is None and licences.confirmed(own, pairs, 0.6, []) is None
    # against counting: random bags of bigrams, every family named
    rng = np.random.default_rng(1)
    every = np.concatenate([t for f in pairs for t, _, _ in f])

    def holds(t, name, own):
        share = sum(x in own for x in t.tolist()) / len(t)
        return share >= (0.6 if len(t) > licences.SHORT else 1) and (not name or any(x in own for x in name))

    for _ in range(200):
        own = rng.choice(every, 25)
        could = {f for f, ts in enumerate(pairs) if any(holds(t, name, set(own.tolist())) for t, _, name in ts)}
        got = licences.confirmed(own, pairs, 0.6, list(range(len(pairs))))
        assert got[0] in could if could else got is None


def test_relatives(spark):
    """Notices of licences that share most of their words, each with its own name."""
    body = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    rows = [(10_000 + i, body.replace("{} ", n)) for i, n in enumerate(("", "Affero ", "Lesser "))]
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    got = {r["doc_id"]: r["families"] for r in licences.scan_licences(docs.unionByName(spark.createDataFrame(rows, docs.schema))).where("doc_id >= 10000").collect()}
    assert [got[10_000 + i] for i in range(3)] == [["gpl"], ["agpl"], ["lgpl"]]
