import random
import re

from tests.llm.helpers import none, odd, rows

from xylem.llm import licenses

#: A licence text.
MIT = """MIT License

Copyright (c) 2020 A B

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER.
"""
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3",
    "Released under the MIT License.": "MIT",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "SPDX-License-Identifier: BSD-2-Clause": "SPDX:BSD-2-Clause",
}


#: Published notices as they are wrapped.
GPL = """ * This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
UNLICENSE = "This is free and unencumbered software released into the public\ndomain."


def found(text):
    return licenses.licences(licenses.sentences(text))


def plain_sentences():
    return [(name, one.replace("#", "2.0")) for name, pattern in licenses.SENTENCES for one, _ in licenses.spelled(pattern)]


def brute(text):
    """Identifiers by a regular expression for each sentence: words with anything but letters, digits and blank lines between."""
    gap = r"(?:(?!\n[^a-z0-9\n]*\n)[^a-z0-9])+"
    low, hits = text.lower(), []
    for name, pattern in licenses.SENTENCES:
        for one, _ in licenses.spelled(pattern):
            words = [r"[0-9]+(?:\.[0-9]+)*(?![0-9])" if w == "#" else w + r"(?![a-z])" for w in one.split()]
            hits += [(m.start(), -len(words), name, m.end()) for m in re.finditer(r"(?<![a-z])" + gap.join(words), low)]
    out, end = [], -1
    for start, _, name, stop in sorted(hits):
        if start >= end:
            out.append(name)
            end = stop
    return out


def in_order(known):
    """Licences and the rest by trying each rule on a list until it fails."""
    rest, out = [x for x in known if x[0] not in licenses.ASIDE], []
    for name, needs in licenses.RULES:
        while True:
            own, at = [], -1
            for need in needs:
                at = next((k for k in range(at + 1, len(rest)) if rest[k][0] == need), None)
                if at is None:
                    break
                own.append(at)
            if len(own) < len(needs):
                break
            out.append(name.split("{")[0])
            rest = [x for k, x in enumerate(rest) if k not in own]
    return out, [x[0] for x in rest]


def test_every_sentence_has_a_cue():
    for name, one in plain_sentences():
        assert any(re.search(licenses.CUES, word) for word in one.split()), name


def test_every_sentence_however_it_is_written(spark):
    rng, ways = random.Random(3), [
        lambda w: " ".join(w), lambda w: "  ".join(w).upper(), lambda w: "\n".join(w), lambda w: "".join(x + rng.choice([" ", "\n", ", ", ".  ", "; ", "\n * ", '" ', "\r\n# ", " ("]) for x in w),
    ]
    texts = [(name, way(one.split())) for name, one in plain_sentences() for way in ways]
    docs = spark.createDataFrame([(k, f"Some words here.\n{t}.\nAnd more of them") for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.sentence_ids for r in licenses.scanned(docs).collect()}
    for k, (name, text) in enumerate(texts):
        assert got[k].split(",")[0] == name, text
    assert licenses.sentences("all rights\n\nreserved") == [] and [x[0] for x in licenses.sentences("all rights\n reserved")] == ["rights-reserved"]


def test_published_notices():
    assert found(GPL) == (["GPL-2-or-later"], []) and found(MPL) == (["MPL-2.0"], []) and found(UNLICENSE) == (["Unlicense"], [])
    assert found(f"{GPL}\n\n{MPL}\n{UNLICENSE}\n{GPL}") == (["GPL-2-or-later", "GPL-2-or-later", "MPL-2.0", "Unlicense"], [])
    assert found("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.") == (["CC-BY-SA-4.0"], [])
    assert found("// SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note\n// SPDX-License-Identifier: MIT\nx") == (["SPDX:GPL-2.0-only WITH Linux-syscall-note", "SPDX:MIT"], [])


def test_rules_equal_brute_force():
    rng, names = random.Random(8), sorted({n for n, _ in licenses.SENTENCES})
    for size in (0, 1, 5, 40, 400):
        for _ in range(10):
            some = rng.sample(names, 9)
            known = [(rng.choice(some if rng.random() < 0.5 else names), {"v": "1", "k": ""}) for _ in range(size)]
            out, rest = licenses.licences(known)
            expected, expected_rest = in_order(known)
            assert len(out) == len(expected) and rest == expected_rest
            assert all(a.startswith(b) for a, b in zip(out, expected, strict=True))


def test_sentences_equal_brute_force():
    rng, all_ = random.Random(4), plain_sentences()
    for _ in range(60):
        parts = [rng.choice(all_)[1].upper() if rng.random() < 0.6 else rng.choice(["some words", "license", "the software is", "permission", "\n\n", "version 2.0"]) for _ in range(rng.randrange(1, 9))]
        text = rng.choice([" ", "\n", ". "]).join(parts)
        assert [x[0] for x in licenses.sentences(text)] == brute(text), text


def test_long_and_repeated_text():
    many = (GPL + "\n\n") * 3000
    assert found(many) == (["GPL-2-or-later"] * 3000, [])


def test_texts():
    assert found(MIT) == (["MIT"], [])
    assert found(f"{MIT}\nLicensed under the Apache License, Version 2.0.") == (["MIT", "Apache-2.0"], [])
    assert found(MIT.replace("copies or substantial", "parts")) == ([], ["mit-title", "mit-grant", "as-is-software", "mit-liability"])
    assert found("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.") == (["LGPL-2.1-or-later"], [])
    assert found("a licence is a kind of permission and copyright is a right") == ([], [])
    for text, name in NOTICES.items():
        for around in ("{}", "word {}", "Sentence. {}\nmore", "a\n{}", "x\n\n{}\n\ny"):
            assert found(around.format(text)) == ([name], []), (around, text)


def test_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.licences for r in licenses.scanned(docs).collect()}
    expected = {r.doc_id: {n for t, n in NOTICES.items() if t in r.text} for r in docs.collect()}
    assert {i: set(filter(None, x.split(","))) for i, x in got.items()} == expected


def test_odd_and_empty(spark):
    got = licenses.scanned(odd(spark)).collect()
    assert len(got) == len(rows()) and all((r.n_sentences, r.licences) == (0, "") for r in got)
    assert licenses.scanned(none(spark)).count() == 0
    copies = spark.createDataFrame([(1, MIT), (1, MIT), (None, MIT)], "doc_id long, text string")
    assert [r.licences for r in licenses.scanned(copies).collect()] == ["MIT"] * 3
