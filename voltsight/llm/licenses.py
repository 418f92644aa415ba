"""Licence scan by sentence rules.

A text is cut into sentences, every sentence is normalised to its lower-case
words, and known licence sentences are mapped to identifiers.  A licence rule
is an ordered list of identifiers; going through a document's identifiers, the
longest rule that matches in order (with at most ``GAP`` unknown sentences
between two of its own) names a licence.  A sentence that wraps over lines is
joined; inside a stretch without sentence ends the longest known run of lines
is taken.  The holder named in a clause is a placeholder, and a list mark before a
sentence is left out.  A licence is also declared by its name after "released",
"licensed" ... "under" anywhere in a sentence ("not" before it, and it isn't), or by
an SPDX-License-Identifier line.

A rule does not name its licence if an unknown sentence within it, or among the
``GAP + 2`` after it, resembles a clause of a longer rule of another licence (it holds
``RESEMBLES`` of the clause's word pairs): the text is then flagged ``unknown``, not
given the shorter rule's name.

Defined results: a null or empty text has no licence; a document whose known
sentences match no rule, or that only mentions a licence in unknown words, is
flagged ``unknown``; a licence declared twice is listed twice; rules of equal length go
in the order they are given; repeated rows get equal results.  Texts are read whole,
however long; an empty table gives no rows; of ``docs`` only ``doc_id`` and ``text``
are read, so other columns may have any name.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP, HOLDER = 2, 12                                     # unknown sentences in a rule, words of a holder's name
RESEMBLES = 0.4                                         # share of a known clause's word pairs in an altered one

# Sentences of public licence texts and notices.
SENTENCES = {
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl-free": "This program is free software;",
    "gpl-2-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl-2-option": "either version 2 of the License, or (at your option) any later version.",
    "gpl-3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "lgpl-free": "This library is free software;",
    "lgpl-2.1-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl-2.1-option": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "lgpl-2.1-head": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl-3-head": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl-3-head": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl-2-only": "you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation.",
    "gpl-2-head": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-3-head": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-3-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "apache-head": "Apache License Version 2.0, January 2004",
    "mpl-2-head": "Mozilla Public License Version 2.0",
    "bsl-head": "Boost Software License - Version 1.0 - August 17th, 2003",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
# Other wordings of such sentences.
VARIANTS = [("gpl-2-only", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
            ("gpl-2-only", "you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation."),
            ("gpl-2-only", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2."),
            ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
            ("bsd-names", "The name of the copyright holder may not be used to endorse or promote products derived from this software without specific prior written permission."),
            ("bsd-names", "The names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission."),
            ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without prior written permission.")]
# Names under which licences are declared, and the forms of a declaration.
NAMES = {
    "MIT": ["MIT License", "MIT Licence", "MIT"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD 2-Clause", "2-Clause BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "BSD 3-Clause", "3-Clause BSD License"],
    "ISC": ["ISC License"], "Unlicense": ["Unlicense"], "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"], "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"], "BSL-1.0": ["Boost Software License, Version 1.0"],
    "Zlib": ["zlib License", "zlib/libpng License"], "CC0-1.0": ["CC0 1.0 Universal License", "CC0 1.0"],
}
# Parts of the Creative Commons names, from which NAMES gets all kinds and versions.
CC_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
CC_KINDS = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
for _kind in CC_KINDS:
    for _version in ("2.0", "2.5", "3.0", "4.0"):
        _long = "Creative Commons " + "-".join(CC_PARTS[x] for x in _kind.split("-")) + " " + _version
        NAMES[f"CC-{_kind}-{_version}"] = [f"CC {_kind} {_version}", f"CC {_kind} {_version} License", f"{_long} License",
                                           f"{_long} International License"]
for _name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
    _kind, _version = _name.split("-")
    _whole = {"GPL": "", "LGPL": "Lesser ", "AGPL": "Affero "}[_kind]
    _short = _version.removesuffix(".0")
    NAMES[_name] += [f"GNU {_whole}General Public License{x} {_version}" for x in ("", " version", " v")]
    NAMES[_name] += [f"GNU {_whole}General Public License v{_version}", f"GNU {_whole}General Public License v{_short}",
                     f"GNU {_whole}General Public License version {_short}", f"{_name}", f"{_kind}v{_short}", f"{_kind} v{_short}", f"GNU {_kind} v{_short}"]
    NAMES[_name].append(f"{_name}-only")
    NAMES[_name + "-or-later"] = [f"{x}{later}" for x in NAMES[_name]
                                  if not x.endswith("-only") for later in (" or later", " or any later version", " or (at your option) any later version")]
for _kind in CC_KINDS:
    _long = "Creative Commons " + "-".join(CC_PARTS[x] for x in _kind.split("-")) + " 4.0 International Public License"
    SENTENCES[f"cc-{_kind.lower()}-4.0"] = ("By exercising the Licensed Rights (defined below), You accept and agree to be bound by the "
                                            f'terms and conditions of this {_long} ("Public License").')
FORMS = ("Released under {}.", "Licensed under {}.", "Distributed under {}.", "Available under {}.",
         "This work is licensed under {}.", "Released under the {}.", "Licensed under the {}.", "Distributed under the {}.", "Available under the {}.",
         "This work is licensed under the {}.", "This work is licensed under a {}.", "This project is licensed under the {}.",
         "This software is released under the {}.", "This file is licensed under the {}.",
         "This project is licensed under the terms of the {}.")
RULES = {
    "MIT": ["mit-grant", "mit-notice", "mit-warranty"], "BSD-2-Clause": ["bsd-grant", "bsd-source", "bsd-binary"],
    "BSD-3-Clause": ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"], "ISC": ["isc-grant"],
    "Apache-2.0": ["apache-grant", "apache-use", "apache-copy", "apache-warranty"],
    "Apache-2.0 (short)": ["apache-grant", "apache-use"], "GPL-2.0-or-later": ["gpl-free", "gpl-2-terms", "gpl-2-option"],
    "GPL-3.0-or-later": ["gpl-free", "gpl-3-terms"], "MPL-2.0": ["mpl-2"], "Unlicense": ["unlicense"],
    "GPL-2.0-or-later (one sentence)": ["gpl-free", "gpl-2-later"],
    "BSD-4-Clause": ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names"],
    "LGPL-2.1-or-later": ["lgpl-free", "lgpl-2.1-terms", "lgpl-2.1-option"], "LGPL-3.0-or-later": ["lgpl-free", "lgpl-3-terms"],
    "LGPL-3.0-or-later (program)": ["gpl-free", "lgpl-3-terms"], "AGPL-3.0-or-later": ["gpl-free", "agpl-3-terms"],
    "GPL-2.0 (notice)": ["gpl-free", "gpl-2-only"], "GPL-3.0 (notice)": ["gpl-free", "gpl-3-only"], "GPL-2.0 (text)": ["gpl-2-head"],
    "GPL-3.0 (text)": ["gpl-3-head"], "Apache-2.0 (text)": ["apache-head"], "MPL-2.0 (text)": ["mpl-2-head"], "Zlib": ["zlib-grant"],
    "BSL-1.0 (text)": ["bsl-head", "bsl-grant"], "BSL-1.0": ["bsl-grant"], "LGPL-2.1": ["lgpl-2.1-head"], "LGPL-3.0": ["lgpl-3-head"], "AGPL-3.0": ["agpl-3-head"],
}
RULES |= {f"CC-{kind}-4.0": [f"cc-{kind.lower()}-4.0"] for kind in CC_KINDS}

_FOLD = re.compile(r"[^a-z0-9]+")
# A sentence ends at . ; : ? (and marks after it) before a blank, but not after "v." or
# in a holder's name ("Inc. nor the names ..."), or at an empty line.
_END = re.compile(r"(?<=[.;:?])(?<!\s[vV]\.)(?!\W{1,40}+(?i:nor\W{1,40}+the\W{1,40}+names?)\b)[^\w\s]*(?=\s|$)|\n\s*\n")
_MARK = re.compile(r"^(?:[0-9]{1,2}|[a-z]|[ivx]{2,4}) ")
_HOLDERS = [(re.compile(r"^neither the names? of .+? nor the names? of (?:(?:its|the|their|any|other) )*contributors\b"),
             "neither the name of holder nor the names of its contributors"),
            (re.compile(r"^(?:the )?names? of .+? (?:may|must) not be used to endorse\b"), "the name of holder may not be used to endorse")]
_PERMISSION = re.compile(r"\bwithout (?:(?:the|specific|prior|express|explicit) )*written (?:permission|consent|authori[sz]ation)(?: (?:of|from) .+)?$")
_SPDX = re.compile(r"spdx-license-identifier:[ \t]*([a-z0-9.+() \t-]+)", re.IGNORECASE)
_UNDER = re.compile(r"\b((?:not|never)(?: \w+)? )?(?:released|licen[sc]ed|distributed|available|provided|published|covered|redistributed) "
                    r"under (?:the |a |an |either )*(?:terms (?:and conditions )?of )?(?:the |a |an |either )*")
_ALSO = re.compile(r" (?:and|or|and or)(?: under)?(?: the| a| an)? ")
MENTION = re.compile(r"\b(?:released|distributed|available|provided|published|covered)\W+under\W+(?:\w+\W+){0,6}?licen[sc]e|\blicen[sc]ed? under\b|\bcopyright\b|\bunder the terms of\b")


def normalised(sentence: str) -> str:
    return _FOLD.sub(" ", sentence.lower()).strip()


def unnamed(sentence: str) -> str:
    """A normalised sentence without list mark and holder."""
    sentence = _MARK.sub("", sentence)
    if " name" in sentence or sentence.startswith("name"):
        for pattern, plain in _HOLDERS:
            sentence = pattern.sub(plain, sentence)
        sentence = _PERMISSION.sub("without specific prior written permission", sentence)
    return sentence


def _pairs(sentence: str) -> set:
    words = sentence.split()
    return set(zip(words, words[1:]))


def _spelled(text: str) -> str:
    """SPDX lines as sentences that declare the same licences."""
    if "icense-" not in text and "ICENSE-" not in text:
        return text
    return _SPDX.sub(lambda m: "\n\nLicensed under " + m[1].replace("+", "-or-later").replace("(", "").replace(")", "").strip(" \t-") + ".\n\n", text)


def _within(ids, more) -> bool:
    rest = iter(more)
    return all(x in rest for x in ids)


class Rules:
    """Known sentences and ordered rules; more of either can be passed in."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: dict[str, list[str]] = RULES,
                 names: dict[str, list[str]] = NAMES, forms=FORMS):
        variants = [v for v in VARIANTS if v[0] in sentences]
        self.known = {unnamed(normalised(text)): ident for ident, text in [*sentences.items(), *variants]}
        self.titles: dict[str, list[tuple[str, str]]] = {}      # by first word, longest first
        self.rules = [(list(ids), name.split(" (")[0]) for name, ids in rules.items()]
        for name, titles in names.items():
            self.rules.append(([f"declares {name}"], name))
            for title in [*titles, name]:
                words = normalised(title)
                self.titles.setdefault(words.split()[0], []).append((words, f"declares {name}"))
                for form in forms:
                    self.known[normalised(form.format(title))] = f"declares {name}"
        self.rules.sort(key=lambda r: -len(r[0]))
        clauses: dict[str, list[set]] = {}
        for sentence, ident in self.known.items():
            clauses.setdefault(ident, []).append(_pairs(sentence))
        # by rule: the clauses by which longer rules of other licences differ from it
        self.further = {tuple(ids): [c for more, other in self.rules if len(more) > len(ids) and other != name and _within(ids, more)
                                     for x in more if x not in ids for c in clauses.get(x, ())] for ids, name in self.rules}
        for found in self.titles.values():
            found.sort(key=lambda x: -len(x[0]))
        self.longest = max(k.count(" ") + 1 for k in self.known) + HOLDER
        # every known sentence holds one of these; a text without them holds none
        anchors = ("licen", "copyright", "permission", "redistribut", "warrant", "software", "mit", "gpl", "apache", "cc", "creative", "bsd", "isc", "zlib", "bsl", "mpl")
        self.anchors = anchors if all(any(a in k for a in anchors) for k in self.known) else ("",)

    def ident(self, sentence: str) -> str | None:
        """Identifier of a normalised sentence."""
        return self.known.get(sentence) or self.known.get(unnamed(sentence))

    def declared(self, sentence: str) -> list[str]:
        """Licences that a normalised sentence declares by name."""
        out = []
        for m in _UNDER.finditer(sentence) if " under " in sentence else ():
            at, end = m.end(), m.group(1) is None
            while end:
                first = sentence[at:].split(" ", 1)[0]
                end = next(((len(t), ident) for t, ident in self.titles.get(first, ())
                            if sentence.startswith(t, at) and sentence[at + len(t):at + len(t) + 1] in ("", " ")), None)
                if end:
                    out.append(end[1])
                    also = _ALSO.match(sentence, at + end[0])
                    at, end = (also.end(), True) if also else (at, None)
        return out

    def sentences(self, text: str):
        """``(identifier or None, words of an unknown sentence)`` of every sentence, in
        order; of an unknown sentence over several lines the first holds all its words."""
        for stretch in _END.split(text):
            whole = normalised(stretch)
            if not whole:
                continue
            ident = self.ident(whole)
            if ident or "\n" not in stretch.strip():
                for x in [ident] if ident else self.declared(whole) or [None]:
                    yield x, "" if x else whole
                continue
            lines, i, other = [n for x in stretch.split("\n") if (n := normalised(x))], 0, []
            while i < len(lines):
                best, size, found, j = 1, 0, None, i
                run = []
                while j < len(lines) and size <= self.longest:
                    run.append(lines[j])
                    size += lines[j].count(" ") + 1
                    j += 1
                    ident = self.ident(" ".join(run)) if size <= self.longest else None
                    if ident:
                        best, found = j - i, ident
                if found:
                    yield from self._unknown_run(other)
                    other = []
                    yield found, ""
                else:
                    other.append(lines[i])
                i += best
            yield from self._unknown_run(other)

    def _unknown_run(self, lines: list[str]):
        words = " ".join(lines)
        for n in range(len(lines)):
            yield None, "" if n else words
        for name in self.declared(words):
            yield name, ""

    def _altered(self, ids, unknown: list[str]) -> bool:
        """Whether an unknown sentence resembles a clause that the rule lacks."""
        clauses = self.further[tuple(ids)]
        return any(len(c & pairs) >= RESEMBLES * len(c) for text in unknown if clauses and text
                   for pairs in [_pairs(text)] for c in clauses)

    def licenses(self, text: str | None) -> tuple[list[str], list[str], bool]:
        """Licences in order, known identifiers in order, and the unknown flag."""
        if not text:
            return [], [], False
        if not any(a in text.lower() for a in self.anchors):
            return [], [], False
        text = _spelled(text)
        every = list(self.sentences(text))
        found = [(n, ident) for n, (ident, _) in enumerate(every) if ident]
        out, i, altered = [], 0, False
        while i < len(found):
            for ids, name in self.rules:
                part = found[i:i + len(ids)]
                if [x[1] for x in part] == ids and all(b[0] - a[0] <= GAP + 1 for a, b in zip(part, part[1:])):
                    if self._altered(ids, [words for _, words in every[part[0][0]:part[-1][0] + GAP + 3]]):
                        altered = True
                    else:
                        out.append(name)
                    i += len(ids)
                    break
            else:
                i += 1
        return out, [ident for _, ident in found], altered or not out and (bool(found) or MENTION.search(text.lower()) is not None)


def licenses(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``doc_id, licenses array<string>, sentences array<string>, unknown`` of every row."""
    rules = rules or Rules()

    def run(texts):
        found = [rules.licenses(t.as_py()) for t in texts]
        strings = pa.list_(pa.string())
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], strings), pa.array([f[1] for f in found], strings),
                                           pa.array([f[2] for f in found], pa.bool_())], ["licenses", "sentences", "unknown"])

    kind = "licenses array<string>, sentences array<string>, unknown boolean"
    return docs.select("doc_id", F.arrow_udf(run, kind)("text").alias("s")).select("doc_id", "s.*")
