"""Licence scans: sentences become identifiers, sequences of identifiers are matched with ordered rules."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Sentences of public licence texts and notices, normalised (lower case, words only, single spaces). A bar is a
# hard end as _HARD sees it in the real text; it may be missing in a text, as where a comma stands for it.
SENTENCES: dict[str, str] = {
    "mit-notice-line": "released under the mit license",
    "mit-licensed-line": "licensed under the mit license",
    "mit-title": "mit license",
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"
        " files the software to deal in the software without restriction including without limitation the rights to use copy modify"
        " merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is"
        " furnished to do so subject to the following conditions"
    ),
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties"
        " of merchantability fitness for a particular purpose and noninfringement"
    ),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "apache-2-line": "licensed under the apache license version 2 0",
    "apache-2-header": "licensed under the apache license version 2 0 the license",
    "apache-2-comply": "you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at",
    "apache-2-basis": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is"
        " basis without warranties or conditions of any kind either express or implied"
    ),
    "gpl-3-line": "this work is licensed under the gnu general public license version 3",
    "gpl-3-or-later": (
        "this program is free software | you can redistribute it and or modify it under the terms of the gnu general public license as"
        " published by the free software foundation | either version 3 of the license or at your option any later version"
    ),
    "gpl-2-or-later": (
        "this program is free software | you can redistribute it and or modify it under the terms of the gnu general public license as"
        " published by the free software foundation | either version 2 of the license or at your option any later version"
    ),
    "gpl-hope": (
        "this program is distributed in the hope that it will be useful but without any warranty | without even the implied warranty of"
        " merchantability or fitness for a particular purpose"
    ),
    "gpl-details": "see the gnu general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
        " conditions are met"
    ),
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
        " in the documentation and or other materials provided with the distribution"
    ),
    "bsd-names": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
        " from this software without specific prior written permission"
    ),
    "cc-by-nc-4-line": "licensed under cc by nc 4 0",
    "cc-by-4-line": "licensed under cc by 4 0",
    "cc-by-sa-4-line": "licensed under cc by sa 4 0",
    "mpl-2-line": "this source code form is subject to the terms of the mozilla public license v | 2 0",
    "unlicense-line": "this is free and unencumbered software released into the public domain",
}

# Ordered rules: (licence, rule, identifiers). The first rule that matches at a place wins, so longer ones stand first.
RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("MIT", "mit-text", ("mit-grant", "mit-keep", "mit-as-is")),
    ("MIT", "mit-short-text", ("mit-grant", "mit-keep")),
    ("ISC", "isc-text", ("isc-grant",)),
    ("Apache-2.0", "apache-2-notice", ("apache-2-header", "apache-2-comply", "apache-2-copy")),
    ("Apache-2.0", "apache-2-notice-short", ("apache-2-header", "apache-2-comply")),
    ("GPL-3.0-or-later", "gpl-3-notice", ("gpl-3-or-later", "gpl-hope", "gpl-details", "gpl-copy")),
    ("GPL-3.0-or-later", "gpl-3-notice", ("gpl-3-or-later", "gpl-hope", "gpl-copy")),
    ("GPL-3.0-or-later", "gpl-3-free", ("gpl-3-or-later",)),
    ("GPL-2.0-or-later", "gpl-2-notice", ("gpl-2-or-later", "gpl-hope", "gpl-details", "gpl-copy")),
    ("GPL-2.0-or-later", "gpl-2-notice", ("gpl-2-or-later", "gpl-hope", "gpl-copy")),
    ("GPL-2.0-or-later", "gpl-2-free", ("gpl-2-or-later",)),
    ("BSD-3-Clause", "bsd-3-text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", "bsd-2-text", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", "mit-line", ("mit-notice-line",)),
    ("MIT", "mit-licensed", ("mit-licensed-line",)),
    ("Apache-2.0", "apache-2-line", ("apache-2-line",)),
    ("Apache-2.0", "apache-2-header", ("apache-2-header",)),
    ("GPL-3.0", "gpl-3-line", ("gpl-3-line",)),
    ("CC-BY-NC-4.0", "cc-by-nc-4-line", ("cc-by-nc-4-line",)),
    ("CC-BY-4.0", "cc-by-4-line", ("cc-by-4-line",)),
    ("CC-BY-SA-4.0", "cc-by-sa-4-line", ("cc-by-sa-4-line",)),
    ("MPL-2.0", "mpl-2-line", ("mpl-2-line",)),
    ("Unlicense", "unlicense-line", ("unlicense-line",)),
]
# The notices of the other GNU licences: (licence, what is free, name, version), with "or later" and with the version alone.
for _id, _what, _name, _version in (
    ("LGPL-2.1", "library", "lesser general", "2 1"), ("LGPL-3.0", "library", "lesser general", "3"), ("LGPL-3.0", "program", "lesser general", "3"),
    ("AGPL-3.0", "program", "affero general", "3"), ("GPL-2.0", "program", "general", "2"), ("GPL-3.0", "program", "general", "3"),
):
    for _late, _end in (("or-later", " or at your option any later version"), ("only", "")):
        _sentence = (
            f"this {_what} is free software | you can redistribute it and or modify it under the terms of the gnu {_name} public license as"
            f" published by the free software foundation | {'either ' if _end else ''}version {_version} of the license{_end}"
        )
        if _sentence not in SENTENCES.values():
            SENTENCES[_key := f"{_id.lower()}-{_what}-{_late}"] = _sentence
            RULES.append((f"{_id}-{_late}", _key, (_key,)))

# Names of licences in lines "licensed under ...", normalised; SPDX identifiers are names too.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("mit", "mit license", "expat license"), "MIT-0": ("mit no attribution license",), "ISC": ("isc license",), "0BSD": ("zero clause bsd license",),
    "Apache-2.0": ("apache license 2 0", "apache license version 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 license", "apache license version 2"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license"),
    "GPL-2.0": ("gplv2", "gpl v2", "gpl version 2", "gnu general public license version 2", "gnu general public license v2 0", "gnu gpl v2"),
    "GPL-3.0": ("gplv3", "gpl v3", "gpl version 3", "gnu general public license version 3", "gnu general public license v3 0", "gnu gpl v3"),
    "GPL-2.0-only": (), "GPL-3.0-only": (), "LGPL-2.1-only": (), "LGPL-3.0-only": (), "AGPL-3.0-only": (),
    "GPL-2.0-or-later": ("gpl 2 0+", "gnu general public license version 2 or later"), "GPL-3.0-or-later": ("gpl 3 0+", "gnu general public license version 3 or later"),
    "LGPL-2.1": ("lgplv2 1", "gnu lesser general public license version 2 1"), "LGPL-2.1-or-later": ("lgpl 2 1+",),
    "LGPL-3.0": ("lgplv3", "gnu lesser general public license version 3"), "LGPL-3.0-or-later": ("lgpl 3 0+",),
    "AGPL-3.0": ("agplv3", "gnu affero general public license version 3"), "AGPL-3.0-or-later": ("agpl 3 0+",),
    "MPL-2.0": ("mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v2 0", "mozilla public license v | 2 0", "mpl v2 0"),
    "EPL-1.0": ("eclipse public license 1 0", "eclipse public license v1 0"), "EPL-2.0": ("eclipse public license 2 0", "eclipse public license v2 0", "eclipse public license v | 2 0"),
    "CDDL-1.0": ("common development and distribution license 1 0",), "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "Zlib": ("zlib license",), "Unlicense": ("the unlicense",), "WTFPL": (), "Artistic-2.0": ("artistic license 2 0",), "OFL-1.1": ("sil open font license version 1 1",),
    "CC0-1.0": ("cc0", "creative commons zero v1 0 universal", "cc0 1 0 universal"), "PSF-2.0": ("psf license",),
}
for _kind, _words in (
    ("BY", "attribution"), ("BY-SA", "attribution sharealike"), ("BY-NC", "attribution noncommercial"), ("BY-ND", "attribution noderivatives"),
    ("BY-NC-SA", "attribution noncommercial sharealike"), ("BY-NC-ND", "attribution noncommercial noderivatives"),
):
    for _version in ("3.0", "4.0"):
        _end = _version.replace(".", " ")
        _forms = (f"cc {_kind.lower().replace('-', ' ')} {_end} license", *(f"creative commons {_words.replace('noncommercial', x)} {_end}{y}" for x in ("noncommercial", "non commercial") for y in ("", " license", " international license", " unported license")))
        NAMES[f"CC-{_kind}-{_version}"] = _forms
for _id, _forms in NAMES.items():
    NAMES[_id] = tuple(dict.fromkeys((*_forms, _id.lower().replace("-", " ").replace(".", " "))))
    RULES += [(_id, "named-line", (f"named:{_id}",)), (_id, "spdx-line", (f"spdx:{_id}",))]
VERBS = ("licensed", "released", "distributed", "available", "provided", "published")
TAILS = ("", *(f" see {x} for {y}" for x in ("license", "the license file", "the license md file", "the license license file", "the license md license md file", "license txt") for y in ("details", "more information")))
# Words before "is licensed under ..." at most, without a no among them.
SUBJECT = 8

# Pieces without identifier that may stand between two of a rule.
GAP = 2

_WORDS = regex.compile(r"[\p{L}\p{N}]+(?:(?<=\p{N})\+)?")
# A hard end closes a sentence; at a line end it may close or go on in the next line.
_HARD = regex.compile(r"[.!?;:](?=[\s\"'”)\]]|$)")
_SPDX = ("spdx", "license", "identifier")


def _spellings(sentence: str) -> list[str]:
    """The sentence with each of its hard ends there or missing."""
    first, *others = sentence.split(" | ")
    out = [first]
    for part in others:
        out = [f"{x}{between}{part}" for x in out for between in (" | ", " ")]
    return out


_KNOWN = {x: i for i, s in SENTENCES.items() for x in _spellings(s)}
for _id, _forms in NAMES.items():
    for _form in (x for f in _forms for x in _spellings(f)):
        for _verb in VERBS:
            for _link in (" under ", " under the ", " under the terms of ", " under the terms of the "):
                for _tail in TAILS:
                    _KNOWN.setdefault(f"{_verb}{_link}{_form}{_tail}", f"named:{_id}")
_IDS = {tuple(x.split()): _id for _id, forms in NAMES.items() for x in forms if x.split()[0] not in ("the", "gnu")}
# Beginnings of known sentences up to a hard end.
_BROKEN = {x[: k + 1] for x in _KNOWN for k, c in enumerate(x) if c == "|"}
_OPENINGS = {tuple(s.split()[:2]) for s in _KNOWN}
_LONGEST = max(len(s.split()) for s in _KNOWN) + SUBJECT


def _spdx(words: list[str]) -> list[str]:
    """Identifiers of the known licences of the expression behind "SPDX-License-Identifier:", whatever joins them."""
    out, k = [], 0
    while k < len(words):
        for n in range(min(8, len(words) - k), 0, -1):
            if found := _IDS.get(tuple(words[k : k + n])):
                out.append(f"spdx:{found}")
                k += n - 1
                break
        k += 1
    return out


def _subject(words: list[str]) -> int:
    """How many words "X is" takes in front of "licensed under"; 0 where no such subject stands."""
    for k, word in enumerate(words[:SUBJECT]):
        if word in ("not", "never", "no", "nor", "neither"):
            return 0
        if word in ("is", "are") and (k + 1 == len(words) or words[k + 1] in VERBS):
            return k + 1
    return 0


def _pieces(text: str):
    """(words, ends hard) of each line piece between sentence ends."""
    for line in text.split("\n"):
        parts = _HARD.split(line)
        for k, part in enumerate(parts):
            words = _WORDS.findall(part.lower())
            if words or k < len(parts) - 1:
                yield words, k < len(parts) - 1


def identifiers(text: str) -> list[tuple[int, int, str]]:
    """(first piece, last piece, identifier) of known sentences, in order.

    A sentence is looked up as the words from the beginning of a piece to the end of this or a later piece, across
    line ends, and across sentence ends (bars) where the known sentence has them; of several the longest counts. "X is" in
    front of "licensed under" is left out. Behind an SPDX tag each known licence of the line counts.
    """
    pieces = list(_pieces(text))
    out, k = [], 0
    while k < len(pieces):
        words, end, best = list(pieces[k][0]), k, None
        if tuple(words[:3]) == _SPDX:
            if len(words) == 3 and pieces[k][1] and k + 1 < len(pieces):
                end = k + 1
                words += pieces[end][0]
            out += [(k, end, found) for found in _spdx(words[3:])]
            k = end + 1
            continue
        subject = _subject(words)
        if subject or tuple(words[:2]) in _OPENINGS or len(words) < 2:
            while True:
                found = len(words) <= _LONGEST and (_KNOWN.get(" ".join(words)) or (subject and _KNOWN.get(" ".join(words[subject:]))))
                if found:
                    best = (end, found)
                if end + 1 == len(pieces) or len(words) >= _LONGEST:
                    break
                if pieces[end][1]:
                    words.append("|")
                    if " ".join(words) not in _BROKEN and " ".join(words[subject:]) not in _BROKEN:
                        break
                end += 1
                words += pieces[end][0]
        if best:
            out.append((k, *best))
            k = best[0]
        k += 1
    return out


def matches(text: str | None) -> list[tuple[str, str, int, int]]:
    """(licence, rule, first piece, last piece) of what the rules recognise, without overlaps, in page order."""
    known = identifiers(text or "")
    out, at = [], 0
    while at < len(known):
        for licence, rule, wanted in RULES:
            part = known[at : at + len(wanted)]
            if tuple(i for *_, i in part) == wanted and all(b[0] - a[1] <= GAP + 1 for a, b in zip(part, part[1:], strict=False)):
                out.append((licence, rule, part[0][0], part[-1][1]))
                at += len(wanted) - 1
                break
        at += 1
    return out


def _scan(batches):
    for batch in batches:
        licences, rules, firsts = [], [], []
        for text in batch.column(1).to_pylist():
            found = matches(text)
            licences.append(sorted({m[0] for m in found}))
            rules.append([m[1] for m in found])
            firsts.append([m[2] for m in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(licences, pa.list_(pa.string())), pa.array(rules, pa.list_(pa.string())), pa.array(firsts, pa.list_(pa.int32()))],
            names=["doc_id", "licences", "rules", "sentences"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licences, rules, sentences) of every row of ``docs`` (doc_id, text).

    ``licences`` are sorted and distinct; ``rules`` and the numbers of the sentences where they begin stand in order.
    Lists are empty for null and empty texts and where nothing is recognised. Other columns are ignored.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    return rows.mapInArrow(_scan, "doc_id long, licences array<string>, rules array<string>, sentences array<int>")
