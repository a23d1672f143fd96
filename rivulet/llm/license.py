"""License scans by sentence rules.

A text is cut into sentences, each is normalised and looked up among known licence sentences; the identifiers found,
in order, are matched against ordered licence rules, each a sequence of identifiers. A rule consumes what it matches,
so the more specific rules come first.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import table

# Sentences of well-known licences and notices, normalised as by `normal`, with `{...}` parts filled
# in from PARTS. Identifiers are of this module.
PARTS = {
    "{released}": ("released", "licensed", "distributed", "published", "available", "this work is licensed", "this work is released", "this file is licensed", "this software is licensed", "this project is licensed", "this code is licensed"),
    "{under}": ("under the", "under", "under a", "under an", "under the terms of the", "under the terms of"),
    "{gplv}": ("version 3", "version 2", "version 2 1", "version 3 or later", "version 2 or later", "version 2 1 or later", "v3", "v2", "v3 0", "v2 0", "v2 1"),
    "{ccv}": ("4 0", "3 0", "2 5", "2 0", "1 0"),
}
SHORT = {
    "MIT-NOTE": "{released} {under} mit license",
    "BSD2-NOTE": "{released} {under} bsd 2 clause license",
    "BSD3-NOTE": "{released} {under} bsd 3 clause license",
    "BSD-NOTE": "{released} {under} bsd license",
    "ISC-NOTE": "{released} {under} isc license",
    "APACHE2-NOTE": "{released} {under} apache license version 2 0",
    "MPL2-NOTE": "{released} {under} mozilla public license version 2 0",
    "EPL2-NOTE": "{released} {under} eclipse public license version 2 0",
    "GPL-NOTE": "{released} {under} gnu general public license {gplv}",
    "LGPL-NOTE": "{released} {under} gnu lesser general public license {gplv}",
    "AGPL-NOTE": "{released} {under} gnu affero general public license {gplv}",
    "BSL-NOTE": "{released} {under} boost software license version 1 0",
    "ZLIB-NOTE": "{released} {under} zlib license",
    "UNLICENSE-NOTE": "{released} {under} unlicense",
    "CC-BY-NOTE": "{released} {under} cc by {ccv}",
    "CC-BY-SA-NOTE": "{released} {under} cc by sa {ccv}",
    "CC-BY-NC-NOTE": "{released} {under} cc by nc {ccv}",
    "CC-BY-ND-NOTE": "{released} {under} cc by nd {ccv}",
    "CC-BY-NC-SA-NOTE": "{released} {under} cc by nc sa {ccv}",
    "CC-BY-NC-ND-NOTE": "{released} {under} cc by nc nd {ccv}",
    "CC0-NOTE": "{released} {under} cc0 1 0 universal license",
    "CC-BY-NOTE#2": "{released} {under} creative commons attribution {ccv} international license",
    "CC-BY-SA-NOTE#2": "{released} {under} creative commons attribution sharealike {ccv} international license",
    "CC-BY-NC-NOTE#2": "{released} {under} creative commons attribution noncommercial {ccv} international license",
    "CC-BY-ND-NOTE#2": "{released} {under} creative commons attribution noderivatives {ccv} international license",
    "CC-BY-NC-SA-NOTE#2": "{released} {under} creative commons attribution noncommercial sharealike {ccv} international license",
    "CC-BY-NC-ND-NOTE#2": "{released} {under} creative commons attribution noncommercial noderivatives {ccv} international license",
    "CC-BY-NOTE#3": "{released} {under} creative commons attribution {ccv} license",
    "CC-BY-SA-NOTE#3": "{released} {under} creative commons attribution sharealike {ccv} license",
    "CC-BY-NOTE#4": "{released} {under} creative commons attribution {ccv} unported license",
    "CC-BY-SA-NOTE#4": "{released} {under} creative commons attribution sharealike {ccv} unported license",
}
LONG = {
    "MIT-GRANT": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MIT-KEEP": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MIT-ASIS": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MIT-LIABILITY": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "BSD-REDISTRIBUTE": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BSD-SOURCE": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BSD-BINARY": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BSD-ENDORSE": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSD-ASIS": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "BSD-LIABILITY": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "BSD-LIABILITY#2": "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "ISC-GRANT": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ISC-ASIS": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "APACHE2-LIC": "licensed under the apache license version 2 0 the license",
    "APACHE2-USE": "you may not use this file except in compliance with the license",
    "APACHE2-COPY": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "APACHE2-ASIS": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "GPL-FREE": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GPL2-FREE": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "GPL-HOPE": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GPL-SEE": "see the gnu general public license for more details",
    "LGPL21-FREE": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "LGPL3-FREE": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "LGPL-HOPE": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "LGPL-SEE": "see the gnu lesser general public license for more details",
    "AGPL3-FREE": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "AGPL-SEE": "see the gnu affero general public license for more details",
    "EPL2-MATERIALS": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "BSL-GRANT": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "ZLIB-ASIS": "this software is provided as is without any express or implied warranty",
    "ZLIB-LIABILITY": "in no event will the authors be held liable for any damages arising from the use of this software",
    "ZLIB-GRANT": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "UNLICENSE-FREE": "this is free and unencumbered software released into the public domain",
    "UNLICENSE-ANYONE": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "MPL2-SUBJECT": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "ALL-RIGHTS": "all rights reserved",
}
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "BSL-1.0", "Zlib", "Unlicense")
# Licence rules in order; `*` stands for the version that the sentence names.
RULES = (
    ("MIT", ("MIT-GRANT", "MIT-KEEP", "MIT-ASIS", "MIT-LIABILITY")),
    ("MIT", ("MIT-GRANT", "MIT-KEEP", "MIT-ASIS")),
    ("MIT", ("MIT-GRANT", "MIT-KEEP")),
    ("BSD-3-Clause", ("BSD-REDISTRIBUTE", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE", "BSD-ASIS", "BSD-LIABILITY")),
    ("BSD-3-Clause", ("BSD-REDISTRIBUTE", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE", "BSD-ASIS")),
    ("BSD-3-Clause", ("BSD-REDISTRIBUTE", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE")),
    ("BSD-2-Clause", ("BSD-REDISTRIBUTE", "BSD-SOURCE", "BSD-BINARY", "BSD-ASIS", "BSD-LIABILITY")),
    ("BSD-2-Clause", ("BSD-REDISTRIBUTE", "BSD-SOURCE", "BSD-BINARY", "BSD-ASIS")),
    ("BSD-2-Clause", ("BSD-REDISTRIBUTE", "BSD-SOURCE", "BSD-BINARY")),
    ("Apache-2.0", ("APACHE2-LIC", "APACHE2-USE", "APACHE2-COPY", "APACHE2-ASIS")),
    ("Apache-2.0", ("APACHE2-LIC", "APACHE2-USE", "APACHE2-COPY")),
    ("Apache-2.0", ("APACHE2-LIC",)),
    ("GPL-3.0-or-later", ("GPL-FREE", "GPL-HOPE", "GPL-SEE")),
    ("GPL-3.0-or-later", ("GPL-FREE",)),
    ("GPL-2.0-or-later", ("GPL2-FREE", "GPL-HOPE", "GPL-SEE")),
    ("GPL-2.0-or-later", ("GPL2-FREE",)),
    ("LGPL-2.1-or-later", ("LGPL21-FREE", "LGPL-HOPE", "LGPL-SEE")),
    ("LGPL-2.1-or-later", ("LGPL21-FREE",)),
    ("LGPL-3.0-or-later", ("LGPL3-FREE", "LGPL-HOPE", "LGPL-SEE")),
    ("LGPL-3.0-or-later", ("LGPL3-FREE",)),
    ("AGPL-3.0-or-later", ("AGPL3-FREE", "GPL-HOPE", "AGPL-SEE")),
    ("AGPL-3.0-or-later", ("AGPL3-FREE",)),
    ("ISC", ("ISC-GRANT", "ISC-ASIS")),
    ("ISC", ("ISC-GRANT",)),
    ("BSL-1.0", ("BSL-GRANT",)),
    ("Zlib", ("ZLIB-ASIS", "ZLIB-LIABILITY", "ZLIB-GRANT")),
    ("Zlib", ("ZLIB-GRANT",)),
    ("Unlicense", ("UNLICENSE-FREE", "UNLICENSE-ANYONE")),
    ("Unlicense", ("UNLICENSE-FREE",)),
    ("EPL-2.0", ("EPL2-MATERIALS",)),
    ("MPL-2.0", ("MPL2-SUBJECT",)),
    ("MIT", ("MIT-NOTE",)),
    ("BSD-2-Clause", ("BSD2-NOTE",)),
    ("BSD-3-Clause", ("BSD3-NOTE",)),
    ("BSD", ("BSD-NOTE",)),
    ("ISC", ("ISC-NOTE",)),
    ("Apache-2.0", ("APACHE2-NOTE",)),
    ("MPL-2.0", ("MPL2-NOTE",)),
    ("EPL-2.0", ("EPL2-NOTE",)),
    ("BSL-1.0", ("BSL-NOTE",)),
    ("Zlib", ("ZLIB-NOTE",)),
    ("Unlicense", ("UNLICENSE-NOTE",)),
    *((f"{x}-{v}-{w}", (f"{x}-NOTE:{v}{'+' if w == 'or-later' else ''}",)) for x in ("GPL", "LGPL", "AGPL") for v in ("3.0", "2.0", "2.1") for w in ("only", "or-later")),
    *((f"{x}-{v}", (f"{x}-NOTE:{v}",)) for v in ("4.0", "3.0", "2.5", "2.0", "1.0") for x in ("CC-BY", "CC-BY-SA", "CC-BY-NC", "CC-BY-ND", "CC-BY-NC-SA", "CC-BY-NC-ND")),
    ("CC0-1.0", ("CC0-NOTE",)),
    *((x, (f"SPDX:{x}",)) for x in SPDX),
    ("Proprietary", ("ALL-RIGHTS",)),
)
#: Every known sentence has one of these, so a text or sentence without them needs no look.
ANCHOR = re.compile(r"licen[cs]e|permi|copyright|warrant|redistribut|liab|as is|rights|under|subject|spdx|unencumbered|anyone is free", re.IGNORECASE)
_CUT = re.compile(r"[.;:!?]+(?=[\s\"')]|$)|\n[ \t]*\n")
_ODD = re.compile(r"[^0-9a-z]+")


def normal(sentence: str) -> str:
    """Lower case; runs of anything but a-z and 0-9 become a space; British spelling of licence goes."""
    return _ODD.sub(" ", sentence.lower()).strip().replace("licence", "license")


def sentences_known() -> dict[str, str]:
    """Identifier of each known sentence. GPL notes have the version in it, with + for later ones."""
    out = {}
    for name, form in SHORT.items():
        ready = [form]
        for part, values in PARTS.items():
            ready = [x.replace(part, v) for x in ready for v in (values if part in x else ("",))]
        for x in ready:
            kind = name.partition("#")[0]
            if "{gplv}" in form:
                major, minor = re.search(r"(?:version |v)(\d)(?: (\d))?", x).groups()
                kind += f":{major}.{minor or 0}" + ("+" if x.endswith("or later") else "")
            if "{ccv}" in form:
                kind += ":" + re.search(r"\d \d", x)[0].replace(" ", ".")
            out[x] = kind
    out |= {v: k.partition("#")[0] for k, v in LONG.items()}
    return out | {normal(f"SPDX-License-Identifier {x}"): f"SPDX:{x}" for x in SPDX}


KNOWN = sentences_known()
#: Known sentences that may have marks or empty lines within, as notices are published with; the short ones may not.
WHOLE = {v: k.partition("#")[0] for k, v in LONG.items()}


def beginnings() -> dict[str, list[str]]:
    """Known sentences by their first two words."""
    out: dict[str, list[str]] = {}
    for x in KNOWN:
        out.setdefault(" ".join(x.split()[:2]), []).append(x)
    return out


BEGINS = beginnings()


def _start_pattern() -> re.Pattern:
    """A place where a sentence can begin, and what isn't a letter or digit after it; the group has two words that known sentences begin with."""
    heads: dict[str, list[str]] = {}
    for x in BEGINS:
        first, second = x.replace("license", "licen[cs]e").split()
        heads.setdefault(first, []).append(second)
    words = "|".join(f"{k}[^0-9A-Za-z]++(?:{'|'.join(v)})" for k, v in heads.items())
    return re.compile(rf"""(?:\A|\n|[.;:!?](?=[\s"')]))[^0-9A-Za-z]*+(?=((?i:{words})(?![0-9A-Za-z]))|)""")


_START = _start_pattern()
_END = re.compile(rf"(?P<cut>{_CUT.pattern})|\n|\Z")
_SPDX = re.compile(rf"SPDX-License-Identifier\s*?(?:{_CUT.pattern})")


def _place(text: str, start: int, head: int) -> int:
    """Where the sentence whose first word is at head begins: after the last cut since start, else at its line."""
    if cuts := list(_CUT.finditer(text, start, head)):
        return cuts[-1].end()
    return text.find("\n", start, head) + 1 or start


def sentence_ids(text: str | None) -> list[tuple[str, int]]:
    """(identifier, place of its sentence in the text) of each known sentence, in order.

    A sentence begins at a line start or after .;:!? before white space or a quote, and ends at such a mark or at a
    line's end: headings and tables end without a mark. The longest known one is taken from each beginning, the next
    begins after it. Long ones may go across marks and empty lines: notices have `free software: you can` and
    `License, v. 2.0`.
    """
    if not text or not ANCHOR.search(text):
        return []
    out, done = [], 0
    for m in _START.finditer(text):
        if m[1] is None or m.end() < done:
            continue
        known, said, names, begin, found = BEGINS.get(normal(m[1]), ()), "", KNOWN, m.end(), None
        for end in _END.finditer(text, begin):
            if words := normal(text[begin : end.start()]):
                said = f"{said} {words}" if said else words
                if not any(x.startswith(said) for x in known):
                    break
                if said in names:
                    found, done = names[said], end.start()
            begin = end.end()
            if end["cut"]:
                names = WHOLE
        if found is not None:
            out.append((found, _place(text, m.start(), m.end())))
    # A colon ends a sentence, but the SPDX tag has one.
    for m in _SPDX.finditer(text):
        end = _CUT.search(text, m.end())
        value = text[m.end() : end.start() if end else len(text)].strip().partition("\n")[0]
        if (found := KNOWN.get(normal("SPDX-License-Identifier " + value))) is not None:
            out.append((found, m.start()))
    return sorted(out, key=lambda x: x[1])


def match_rules(ids: list[str]) -> tuple[list[str], int]:
    """(licences in the order they were matched, identifiers left over). Rules are tried in order, each from the left."""
    left: list[str | None] = list(ids)
    out: list[tuple[int, str]] = []
    have = set(ids)
    for licence, rule in RULES:
        if not have.issuperset(rule):
            continue
        k = 0
        while k + len(rule) <= len(left):
            if tuple(left[k : k + len(rule)]) == rule:
                out.append((k, licence))
                left[k : k + len(rule)] = [None] * len(rule)
                k += len(rule)
            else:
                k += 1
    return [x for _, x in sorted(out)], sum(x is not None for x in left)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licences, sentence_ids, places, n_unmatched) of each row of (doc_id, text).

    licences: distinct, in the order of their first match; sentence_ids: identifiers in order; places: where each
    begins in the text. Null and empty texts, and those without known sentences, have empty lists.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [sentence_ids(t) for t in pdf["text"]]
            matched = [match_rules([k for k, _ in x]) for x in found]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "licences": [list(dict.fromkeys(x)) for x, _ in matched], "sentence_ids": [[k for k, _ in x] for x in found],
                "places": [[p for _, p in x] for x in found], "n_unmatched": [n for _, n in matched],
            })

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id long, licences array<string>, sentence_ids array<string>, places array<int>, n_unmatched int")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op1_license_scan": op1_license_scan}
