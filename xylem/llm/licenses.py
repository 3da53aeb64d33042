"""Licence scan by sentence rules.

A text is read as a sequence of words and numbers; punctuation, case, comment marks and line ends make
no difference. A table of known licence sentences in that form is a token trie: at each token the
longest known sentence that begins there becomes an identifier, and reading goes on behind it. A
sentence may be wrapped over any number of lines but not over a blank one.

The sequence of identifiers is then matched against licence rules in order: a rule is a sequence that
must appear in this order; the first rule that matches takes its identifiers away and matching goes on
with the rest, so a file with several licences gets all of them. Identifiers no rule takes are reported.

Only texts with a cue can hold a known sentence: every known sentence has a word that holds one, so line
ends can't break it. The JVM blanks the other texts before they go to Python. One pass, no shuffle;
the work grows with the length of a text.

Defined cases: null, empty and cue-free texts have no sentences and no licence; of sentences that begin
at one token the longest wins; repeated rows get a row each; very long texts are scanned whole; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import OWN

CUES = r"licen[sc]|copyright|warrant|permi[st]|spdx|domain|liable|software|distribut|reserved|reproduction|(?<![a-z])cc"

#: Identifier and normalised sentence. # is a number, a/b either word (_ is none, ~ joins words of
#: one choice), {k} a kind of GNU licence, {cc} the terms of a Creative Commons licence.
SENTENCES: list[tuple[str, str]] = [
    ("spdx", "spdx license identifier"),
    ("copyright", "copyright c/_ #"),
    ("rights-reserved", "all rights reserved"),
    ("apache-notice", "licensed under the apache license version/v/_ #"),
    ("apache-title", "apache license version #"),
    ("apache-terms", "terms and conditions for use reproduction and distribution"),
    ("apache-use", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("apache-basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit-released", "released/licensed/distributed under the/the~terms~of~the mit license"),
    ("mit-title", "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is-software", "the software is provided as is without warranty of any kind express or implied"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("gnu-work", "licensed/released/distributed under the/the~terms~of~the gnu {k} general public license version/v/_ #"),
    ("gnu-title", "gnu {k} general public license version #"),
    ("gnu-later", "free software you can redistribute it and or modify it under the terms of the gnu {k} general public license as published by the free software foundation either version # of the license or at your option any later version"),
    ("gnu-only", "free software you can redistribute it and or modify it under the terms of the gnu {k} general public license as published by the free software foundation version # of the license"),
    ("gnu-only", "free software you can redistribute it and or modify it under the terms of the gnu {k} general public license version # as published by the free software foundation"),
    ("gnu-hope", "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gnu-see", "see the gnu lesser/affero/library/_ general public license for more details"),
    ("gnu-copy", "you should have received a copy of the gnu lesser/affero/library/_ general public license"),
    ("bsd-conditions", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software must display the following acknowledgement/acknowledgment"),
    ("bsd-endorse", "be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-as-is", "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-liability", "be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("isc-grant", "permission to use copy modify and/_ or/and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd-grant", "permission to use copy modify and/_ or/and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-as-is", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v #"),
    ("mpl-copy", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib-origin", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost-notice", "distributed under the boost software license version #"),
    ("boost-grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("eclipse-notice", "made available under the/the~terms~of~the eclipse public license version/v/_ #"),
    ("european-notice", "licensed under the eupl version/v/_ #"),
    ("wtf-copies", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("cc-notice", "licensed under a/the/_ cc/creative~commons {cc} #"),
    ("cc-zero", "released/licensed/dedicated/available under/to cc 0"),
    ("cc-zero", "cc 0 # universal"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("public-domain", "released~into/placed~in/dedicated~to/is~in the public domain"),
]
#: Licence and the identifiers it needs, in order; a longer rule stands before the shorter one it holds.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-{v}", ("apache-notice", "apache-use", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-{v}", ("apache-title", "apache-terms")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is-software", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "as-is-software", "mit-liability")),
    ("{k}GPL-{v}-or-later", ("gnu-later", "gnu-hope", "gnu-see", "gnu-copy")),
    ("{k}GPL-{v}-or-later", ("gnu-later", "gnu-hope", "gnu-see")),
    ("{k}GPL-{v}-or-later", ("gnu-later",)),
    ("{k}GPL-{v}-only", ("gnu-only", "gnu-hope", "gnu-see", "gnu-copy")),
    ("{k}GPL-{v}-only", ("gnu-only",)),
    ("BSD-4-Clause", ("bsd-conditions", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-as-is", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-conditions", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("MPL-{v}", ("mpl-notice", "mpl-copy")),
    ("MPL-{v}", ("mpl-notice",)),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin")),
    ("BSL-{v}", ("boost-notice",)),
    ("BSL-1.0", ("boost-grant",)),
    ("EPL-{v}", ("eclipse-notice",)),
    ("EUPL-{v}", ("european-notice",)),
    ("WTFPL", ("wtf-copies",)),
    ("Apache-{v}", ("apache-notice",)),
    ("{k}GPL-{v}", ("gnu-work",)),
    ("{k}GPL-{v}", ("gnu-title",)),
    ("MIT", ("mit-released",)),
    ("CC-{k}-{v}", ("cc-notice",)),
    ("CC0", ("cc-zero",)),
    ("Unlicense", ("unlicense",)),
    ("Public-domain", ("public-domain",)),
    ("SPDX:{v}", ("spdx",)),
]
#: Identifiers that stand beside a licence and aren't part of one.
ASIDE = {"copyright", "rights-reserved"}
GNU_KINDS = {"": "", "lesser": "L", "library": "L", "affero": "A"}
#: Words of the terms of a Creative Commons licence, long and short.
_TERMS = {"NC": ("noncommercial", "non commercial", "nc"), "SA": ("sharealike", "share alike", "sa"), "ND": ("noderivatives", "noderivs", "no derivatives", "nd")}

_TOKEN = re.compile(r"[0-9]+(?:\.[0-9]+)*|[a-z]+|\n")
_SPDX = re.compile(r"spdx\W{0,3}license\W{0,3}identifier[ \t]*:?[ \t]*([a-z0-9.+()\- \t]*)", re.I)


def tokens(text: str) -> list[str]:
    """Lower-case words, numbers (2.0 is one) and line ends."""
    return _TOKEN.findall(text.lower())


def _creative_terms() -> Iterator[tuple[str, str]]:
    """(words, short name) of the terms of Creative Commons licences."""
    for extra in ((), ("NC",), ("SA",), ("ND",), ("NC", "SA"), ("NC", "ND")):
        for words in itertools.product(("attribution", "by"), *[_TERMS[t] for t in extra]):
            yield " ".join(words), "-".join(("BY", *extra))


def spelled(sentence: str) -> Iterator[tuple[str, str]]:
    """All (plain sentence, kind) that a sentence of the table stands for."""
    if "{k}" in sentence:
        kinds = [(sentence.replace("{k}", word or "_"), kind) for word, kind in GNU_KINDS.items()]
    elif "{cc}" in sentence:
        kinds = [(sentence.replace("{cc}", word), kind) for word, kind in _creative_terms()]
    else:
        kinds = [(sentence, "")]
    for one, kind in kinds:
        for choice in itertools.product(*[w.split("/") for w in one.split()]):
            yield " ".join(" ".join(c for c in choice if c != "_").replace("~", " ").split()), kind


def _trie() -> dict:
    """Nested dicts by token; the value at key '' is (identifier, kind) of the sentence that ends there."""
    root: dict = {}
    for name, sentence in SENTENCES:
        for plain, kind in spelled(sentence):
            node = root
            for token in plain.split():
                node = node.setdefault(token, {})
            node.setdefault("", (name, kind))
    return root


TRIE = _trie()


def longest(words: list[str], at: int) -> tuple[int, tuple[str, str], str] | None:
    """(place behind it, (identifier, kind), number) of the longest known sentence that begins at a place."""
    node, found, number, after_line_end = TRIE, None, "", False
    for k in range(at, len(words)):
        word = words[k]
        if word == "\n":
            if after_line_end:
                break
            after_line_end = True
            continue
        after_line_end = False
        if word in node:
            node = node[word]
        elif word[0].isdigit() and "#" in node:
            node, number = node["#"], word
        else:
            break
        if "" in node:
            found = k + 1, node[""], number
    return found


def sentences(text: str) -> list[tuple[str, dict[str, str]]]:
    """Known sentences in order, with their values (number, kind)."""
    words, out, k, noted = tokens(text), [], 0, None
    while k < len(words):
        found = longest(words, k) if words[k] in TRIE else None
        if not found:
            k += 1
            continue
        k, (name, kind), number = found
        if name == "spdx":
            noted = _SPDX.finditer(text) if noted is None else noted
            number = " ".join(next(noted, [None, ""])[1].split())
        out.append((name, {"v": number, "k": kind}))
    return out


def licences(known: list[tuple[str, dict[str, str]]]) -> tuple[list[str], list[str]]:
    """Licences in the order of the rules, each rule as often as it matches, and identifiers no rule takes.

    A rule takes the earliest places that are free. Places that lie before the identifier needed ahead of
    them are of no use to later matches of the rule either, so each rule goes through the places once.
    """
    places: dict[str, list[int]] = {}
    for k, (name, _) in enumerate(known):
        places.setdefault(name, []).append(k)
    taken, out = {k for k, x in enumerate(known) if x[0] in ASIDE}, []
    for rule, needs in RULES:
        if any(n not in places for n in needs):
            continue
        heads = dict.fromkeys(needs, 0)
        while True:
            at, own = -1, []
            for need in needs:
                row = places[need]
                while heads[need] < len(row) and (row[heads[need]] <= at or row[heads[need]] in taken):
                    heads[need] += 1
                if heads[need] == len(row):
                    break
                at = row[heads[need]]
                own.append(at)
            if len(own) < len(needs):
                break
            taken.update(own)
            values = {"v": "", "k": ""} | {k: v for t in own for k, v in known[t][1].items() if v}
            out.append(rule.format(**values))
    return out, [x[0] for k, x in enumerate(known) if k not in taken]


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licences, unmatched (names joined by commas) for every row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = F.when(text.rlike(rf"(?i)(?:{CUES})"), text)
    held = docs.select("doc_id", told.alias(f"{OWN}t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                known = sentences(text.as_py()) if text.is_valid else []
                found, rest = licences(known) if known else ([], [])
                rows.append((len(known), ",".join(x[0] for x in known), ",".join(found), ",".join(rest)))
            columns = [pa.array([r[k] for r in rows], pa.int64() if not k else pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_sentences", "sentence_ids", "licences", "unmatched"])

    return held.mapInArrow(run, f"doc_id {dict(held.dtypes)['doc_id']}, n_sentences long, sentence_ids string, licences string, unmatched string")
