"""Licence scan, byte-level BPE, PII, quality classifier: small tables, odd rows, brute force."""

import datetime
import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from rivulet.llm import bpe, license, pii, quality

DOCS = "doc_id long, text string, score double, ids string, n_found string"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, 1.0, "x", "y") for k, t in texts], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "one two"), (4, "same"), (4, "same"), (5, "x" * 200_000), (6, "a b " * 30_000)]

# -- licence scan ------------------------------------------------------------------------------------------------------
MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. Something else. All rights reserved."""


def test_license_sentences_and_rules(spark):
    texts = [(1, MIT), (2, "a | b\nReleased under the MIT License.\nMore text."), (3, "Licensed under CC BY-NC 4.0. Then: nothing"), (4, "// SPDX-License-Identifier: Apache-2.0\nint x;"), (5, "a licensed plumber. Not released under the MIT License, though."), (6, "Distributed under the GNU General Public License, version 2 or later.")]
    got = {r["doc_id"]: r for r in license.scan(docs(spark, texts)).collect()}
    assert got[1]["sentence_ids"] == ["MIT-GRANT", "MIT-KEEP", "ALL-RIGHTS"] and got[1]["licences"] == ["MIT", "Proprietary"]
    assert got[2]["licences"] == ["MIT"] and texts[1][1][got[2]["places"][0] :].startswith("Released")
    assert got[3]["licences"] == ["CC-BY-NC-4.0"]
    assert got[4]["licences"] == ["Apache-2.0"]
    assert got[5]["licences"] == []
    assert got[6]["licences"] == ["GPL-2.0-or-later"]


def test_license_order_decides():
    assert license.match_rules(["MIT-GRANT", "MIT-KEEP", "MIT-ASIS", "MIT-LIABILITY", "MIT-KEEP"]) == (["MIT"], 1)
    assert license.match_rules(["BSD-REDISTRIBUTE", "BSD-SOURCE", "BSD-BINARY", "BSD-ASIS"]) == (["BSD-2-Clause"], 0)
    assert license.match_rules(["BSD-REDISTRIBUTE", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE", "BSD-ASIS"]) == (["BSD-3-Clause"], 0)
    assert license.match_rules(["MIT-KEEP", "MIT-GRANT"]) == ([], 2)


def test_license_known_sentences_have_an_anchor_and_are_normal():
    assert all(license.ANCHOR.search(k) and license.normal(k) == k for k in license.KNOWN)


def test_license_odd_rows(spark):
    got = license.scan(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r["licences"] == [] and r["n_unmatched"] == 0 for r in got)
    assert license.scan(docs(spark, [])).count() == 0


GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL2 = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
APACHE2 = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
MPL2 = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_license_published_notices(prefix):
    for text, ids, licence in (
        (GPL3, ["GPL-FREE", "GPL-HOPE", "GPL-SEE"], "GPL-3.0-or-later"),
        (GPL2, ["GPL2-FREE", "GPL-HOPE", "GPL-SEE"], "GPL-2.0-or-later"),
        (APACHE2, ["APACHE2-LIC", "APACHE2-USE", "APACHE2-COPY", "APACHE2-ASIS"], "Apache-2.0"),
        (MPL2, ["MPL2-SUBJECT"], "MPL-2.0"),
    ):
        if text is APACHE2 and prefix:
            continue
        text = "Title\n\n" + "".join(prefix + x for x in text.splitlines(keepends=True))
        found = license.sentence_ids(text)
        assert [k for k, _ in found] == ids and license.match_rules(ids) == ([licence], 0)
        assert all(license.normal(text[p:]).startswith(next(x for x, k in license.KNOWN.items() if k == i)) for i, p in found)


BSD3 = """Copyright (c) 2021, Somebody. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.

* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
LGPL = GPL3.replace("program", "library").replace("General Public", "Lesser General Public").replace("version 3", "version 2.1")
AGPL = GPL3.replace("General Public", "Affero General Public")


def test_license_more_published_notices():
    for text, ids, licences in (
        (BSD3, ["BSD-REDISTRIBUTE", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE", "BSD-ASIS", "BSD-LIABILITY"], ["BSD-3-Clause"]),
        (ZLIB, ["ZLIB-ASIS", "ZLIB-LIABILITY", "ZLIB-GRANT"], ["Zlib"]),
        (UNLICENSE, ["UNLICENSE-FREE", "UNLICENSE-ANYONE"], ["Unlicense"]),
        (LGPL, ["LGPL21-FREE", "LGPL-HOPE", "LGPL-SEE"], ["LGPL-2.1-or-later"]),
        (AGPL, ["AGPL3-FREE", "GPL-HOPE", "AGPL-SEE"], ["AGPL-3.0-or-later"]),
        ("Licensed under the GNU Lesser General Public License v2.1", ["LGPL-NOTE:2.1"], ["LGPL-2.1-only"]),
        ("Released under CC BY-SA 3.0.", ["CC-BY-SA-NOTE:3.0"], ["CC-BY-SA-3.0"]),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-NOTE:4.0"], ["CC-BY-4.0"]),
        ("This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", ["CC-BY-NC-ND-NOTE:4.0"], ["CC-BY-NC-ND-4.0"]),
    ):
        found = [k for k, _ in license.sentence_ids(text) if k != "ALL-RIGHTS"]
        assert found == ids and license.match_rules(ids) == (licences, 0)


def by_every_stretch(text):
    """Identifiers by trying, from each place a sentence can begin, every place it can end; the longest wins."""
    begins = [0, *(m.end() for m in re.finditer(r"\n|[.;:!?](?=[\s\"')])", text))]
    ends = [(m.start(), m["cut"] is not None) for m in license._END.finditer(text)]
    out, done = [], 0
    for b in begins:
        word = re.compile(r"[0-9A-Za-z]").search(text, b)
        if word is None or word.start() < done:
            continue
        best, cuts = None, 0
        for e, is_cut in ends:
            if e < word.start():
                continue
            if (k := (license.WHOLE if cuts else license.KNOWN).get(license.normal(text[word.start() : e]))) is not None:
                best = (k, e)
            cuts += is_cut
        if best:
            out.append(best[0])
            done = best[1]
    return out


def test_license_sentences_match_brute_force():
    rng = np.random.default_rng(8)
    known = [x for x in license.KNOWN if not x.startswith("spdx")]
    parts = [" ".join(x.split()[:k]) for x in known for k in (len(x.split()), len(x.split()), 3)] + ["some words", "or later", "version 2", "all rights"]
    for _ in range(120):
        text = "".join(str(rng.choice(parts)) + str(rng.choice([". ", "\n", ";\n", ".\n\n", ", ", " ", ": "])) for _ in range(6))
        assert [k for k, _ in license.sentence_ids(text)] == by_every_stretch(text)


def test_license_short_sentences_end_at_marks():
    assert license.sentence_ids("Released under the MIT. License") == []
    assert license.sentence_ids("Released under the GNU General Public License, version 2. Or later.")[0][0] == "GPL-NOTE:2.0"


def test_license_unmarked_lines_before_other_text():
    for text, ids in (
        ("Released under the MIT License\nSee docs for more.", ["MIT-NOTE"]),
        ("All rights reserved\nNext line", ["ALL-RIGHTS"]),
        ("Tool\nReleased under the\nMIT License\nAll rights reserved\nThe end", ["MIT-NOTE", "ALL-RIGHTS"]),
        ("Licensed under the GNU General Public License, version 2\nor later\nand so on", ["GPL-NOTE:2.0+"]),
        ("Not all rights reserved\nfor all", []),
        ("".join("# " + x for x in APACHE2.splitlines(keepends=True)), ["APACHE2-LIC", "APACHE2-USE", "APACHE2-COPY", "APACHE2-ASIS"]),
        ("All rights reserved\n" * 3000, ["ALL-RIGHTS"] * 3000),
        ("SPDX-License-Identifier: \nMIT\nmore", ["SPDX:MIT"]),
    ):
        assert [k for k, _ in license.sentence_ids(text)] == ids


# -- byte-level BPE ----------------------------------------------------------------------------------------------------
PATH = P.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def ours():
    return bpe.Bpe(bpe.load_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def theirs(ours):
    return tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


def test_bpe_agrees_with_tiktoken(ours, theirs):
    rng = np.random.default_rng(3)
    letters = list("abcdeé xñ日😀$#'\n\t1") + ["\x1c", "\u00a0", " ", "  ", "'s", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 120))) for _ in range(1500)]
    texts += ["a" * 3000, " " * 500, "ab" * 900, "日本語" * 300, "don't I'LL 1234567890", "z" * 65, "x " * 2000, " lead", "trail ", "\n"]
    for t, ids in zip(texts, ours.encode_batch(texts), strict=True):
        assert ids.tolist() == theirs.encode_ordinary(t)
        assert ours.decode(ids.tolist()) == t.encode()


def test_bpe_group_and_single_merges_agree(ours):
    pieces = [b"hello", b"aaaaaaa", "straße".encode(), bytes(range(60)), b"\xff\xfe\xfd", b"ab"]
    assert [np.frombuffer(x, np.int32).tolist() for x in ours.merge_group(pieces)] == [ours.merge_one(p) for p in pieces]


@pytest.mark.parametrize("pattern", [r"\S+\s*|\s+", r"[^a]+|a", r"(?s:.)+"])
def test_bpe_of_other_patterns(ours, pattern):
    other, theirs = bpe.Bpe(ours.ranks, pattern), tiktoken.Encoding("y", pat_str=pattern, mergeable_ranks=ours.ranks, special_tokens={})
    texts = ["one two  three a b", " lead and trail ", "a a a", "don't stop 12 34\n x", ""]
    assert [x.tolist() for x in other.encode_batch(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_bpe_refuses_bytes_that_are_no_tokens():
    small = bpe.Bpe({bytes([b]): b for b in range(97, 123)} | {b"ab": 300}, r"\S+")
    assert [x.tolist() for x in small.encode_batch(["abc", ""])] == [[300, 99], []]
    with pytest.raises(ValueError):
        list(small.encode_batch(["abc", "A"]))


def test_bpe_forgets_and_goes_on(ours, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    for t in ("one two three four", "five six one two", "one"):
        assert next(ours.encode_batch([t])).tolist() == theirs.encode_ordinary(t)


def test_bpe_tables_and_odd_rows(spark, theirs):
    df = docs(spark, ODD)
    out = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert out.columns == ["doc_id", "text", "score", "n_found", "ids", "decoded"]
    for r in out.collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["ids"] == theirs.encode_ordinary(r["text"] or "")
    digests = {r["doc_id"]: r for r in bpe.digests(df, PATH, P.PATTERN).collect()}
    assert digests[1]["n_tokens"] == 0 and digests[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(docs(spark, []), PATH, P.PATTERN).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH, P.PATTERN).first()["decoded"] == b""


# -- PII ---------------------------------------------------------------------------------------------------------------


KEY = "a key of tests"


def luhn(x):
    d = [int(c) for c in re.sub(r"\D", "", x)][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * k, 10)) for k in d[1::2])) % 10 == 0


def one(spark, text):
    r = pii.pseudonymised(docs(spark, [(1, text)]), KEY).first()
    return r["text"], r["n_found"]


def test_pii_grouped_ibans_and_numbers_abroad(spark):
    text = "DE89 3704 0044 0532 0130 00 | ES91 2100 0418 4502 0005 1332 2024 | DE89370400440532013000 | DE88 3704 0044 0532 0130 00 | +49 30 1234567 | +49 (0)30 1234567 | +33 1 23 45 67 89 | +34912345678 | +12025550143 | +1 202-555-0143"
    out, n = one(spark, text)
    was, now = text.split(" | "), out.split(" | ")
    assert n == 9 and now[3] == was[3] and all(a != b for k, (a, b) in enumerate(zip(was, now)) if k != 3)
    assert all(re.sub("[0-9]", "#", a) == re.sub("[0-9]", "#", b) for a, b in zip(was, now))
    for x in (now[0], now[1].removesuffix(" 2024"), now[2]):
        x = x.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert now[0].replace(" ", "") == now[2] and now[1].endswith(" 2024")
    assert now[4].replace("+49 ", "+49 (0)") == now[5] and now[6].startswith("+33 ") and now[7].startswith("+34")
    assert re.sub(r"\D", "", now[8]) == re.sub(r"\D", "", now[9])


def test_pii_values_are_replaced_in_their_format(spark):
    cases = {
        "4845168114407329": r"\d{16}", "4845-1681-1440-7329": r"\d{4}-\d{4}-\d{4}-\d{4}", "+1 (171) 555-2028": r"\+1 \(\d{3}\) \d{3}-\d{4}", "078-05-1120": r"\d{3}-\d\d-\d{4}",
        "116.75.34.232": r"(\d{1,3}\.){3}\d{1,3}", "Jo.81@mail7.example.com": r"[A-Z][a-z]\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", "1999-02-28": r"\d{4}-\d\d-\d\d", "31.12.2001": r"\d\d\.\d\d\.\d{4}", "12/31/2001": r"\d\d/\d\d/\d{4}",
        "GB82WEST12345698765432": r"GB\d\d[A-Z]{4}\d{14}",
    }
    text = " ; ".join(cases)
    got, n = one(spark, f"see {text}!")
    parts = got[4:-1].split(" ; ")
    assert n == len(cases)
    for (old, shape), new in zip(cases.items(), parts, strict=True):
        assert re.fullmatch(shape, new) and new != old
    assert luhn(parts[0]) and re.sub("-", "", parts[1]) == parts[0]
    assert all(int(x) < 256 for x in parts[4].split("."))
    datetime.date.fromisoformat(parts[6])
    datetime.datetime.strptime(parts[7], "%d.%m.%Y")
    iban = parts[9][4:] + parts[9][:4]
    assert int("".join(str(int(c, 36)) for c in iban)) % 97 == 1


def test_pii_leaves_what_is_not_valid(spark):
    text = "9807915762804490 1999-02-30 300.1.1.1 1.2.3.4.5 000-12-3456 v1.2.3 GB82WEST12345698765433 a@b 12:30 2020"
    assert one(spark, text) == (text, 0)


def test_pii_equal_values_stay_linked(spark):
    got = [r["text"] for r in pii.pseudonymised(docs(spark, [(1, "x 4845168114407329"), (2, "4845168114407329, jo@a.org"), (3, "jo@a.org 4845 1681 1440 7329")]), KEY).collect()]
    card = got[0][2:]
    assert got[1].startswith(card + ",") and got[1].split(", ")[1] == got[2].split()[0]
    assert re.sub(" ", "", got[2].split(" ", 1)[1]) == card
    other = pii.pseudonymised(docs(spark, [(1, "x 4845168114407329")]), key="another").first()["text"]
    assert other[2:] != card


def test_pii_networks_are_permutations(spark):
    df = spark.range(17 * 43).select(pii.permute(F.col("id"), F.lit(17), F.lit(43), "k", "t").alias("y"))
    assert sorted(r["y"] for r in df.collect()) == list(range(17 * 43))
    two = spark.range(100).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 2, "0"), "k").alias("y"))
    assert len({r["y"] for r in two.collect()}) == 100
    letters = spark.createDataFrame([(a + b,) for a in "abcdefgh" for b in "xyz0123456789"], "s string").select("s", pii.permute_text(F.col("s"), "k", "t").alias("y")).collect()
    assert len({r["y"] for r in letters}) == len(letters)
    assert all(re.sub("[a-z]", "a", re.sub(r"\d", "0", r["s"])) == re.sub("[a-z]", "a", re.sub(r"\d", "0", r["y"])) for r in letters)


def test_pii_odd_rows(spark):
    df = docs(spark, ODD)
    out = pii.pseudonymised(df, KEY)
    assert set(out.columns) == set(df.columns)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(ODD, key=str)
    assert pii.pseudonymised(docs(spark, []), KEY).count() == 0


# For each pattern, what it repeats: none may take a frame of the matcher's stack for each turn, or long.
LONG_TEXTS = ["x@" + "a." * 200_000, "x@" + "a" * 200_000 + ".com", "a" * 200_000 + "@b.com", "x@" + "a-" * 200_000 + ".com", "a.b@" * 100_000, "DE89" + " 3704" * 200_000, "DE89" + "A" * 200_000, "1." * 200_000, "1.1.1.1." * 50_000, "2020-01-" * 50_000, "123-45-" * 50_000, "+49 " + "(1)" * 200_000, "+49 " * 100_000, "555-123-" * 50_000, "1" * 400_000, "1234 " * 100_000, "1234-" * 100_000, "@" * 200_000, "+1 " * 100_000]


def test_pii_long_repeats(spark):
    df = docs(spark, list(enumerate(LONG_TEXTS))).repartition(4)
    got = {r["doc_id"]: r for r in pii.pseudonymised(df, KEY).collect()}
    assert all(len(got[k]["text"]) == len(t) for k, t in enumerate(LONG_TEXTS))
    # Beyond what DNS and SMTP allow there is no address.
    assert all(got[k]["text"] == LONG_TEXTS[k] for k in (0, 1, 2, 3))
    long_domain, longest = "x@" + "abcdefghi." * 26 + "com", "x@" + "abcdefghi." * 25 + "com"
    assert one(spark, long_domain) == (long_domain, 0)
    assert one(spark, longest)[1] == 1


def test_pii_keys(spark):
    with pytest.raises(ValueError):
        pii.pseudonymised(docs(spark, []), "")
    assert pii.key_of(spark) == pii.key_of(spark) and len(pii.key_of(spark)) >= 32


def by_rows(text, key=KEY):
    """The same networks for cards and dates, one value at a time, in Python."""

    def h(tag, *parts):
        return int(hashlib.sha256("|".join([key, tag, *map(str, parts)]).encode()).hexdigest()[:15], 16)

    def card(m):
        d = re.sub(r"\D", "", m)
        p = d[:-1]
        low = len(p) // 2
        a, b = 10 ** (len(p) - low), 10**low
        x, y = int(p[: len(p) - low]), int(p[len(p) - low :])
        for r in range(pii.ROUNDS):
            x, y = ((x + h("card", len(p), r, y)) % a, y) if r % 2 == 0 else (x, (y + h("card", len(p), r, x)) % b)
        new = str(x).zfill(len(p) - low) + str(y).zfill(low)
        new += next(c for c in "0123456789" if luhn(new + c))
        digits = iter(new)
        return re.sub(r"\d", lambda _: next(digits), m)

    def date(m):
        at = (datetime.date.fromisoformat(m) - datetime.date(1900, 1, 1)).days
        x, y = divmod(at, pii.DAYS_B)
        for r in range(pii.ROUNDS):
            x, y = ((x + h("date", r, y)) % pii.DAYS_A, y) if r % 2 == 0 else (x, (y + h("date", r, x)) % pii.DAYS_B)
        return str(datetime.date(1900, 1, 1) + datetime.timedelta(x * pii.DAYS_B + y))

    return re.sub(r"\d{4}-\d\d-\d\d", lambda m: date(m[0]), re.sub(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}", lambda m: card(m[0]) if luhn(m[0]) else m[0], text))


def test_pii_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = []
    for k in range(60):
        n = "".join(map(str, rng.integers(0, 10, 15)))
        n += next(c for c in "0123456789" if luhn(n + c)) if k % 5 else "0"
        n = n if k % 2 else " ".join(n[i : i + 4] for i in range(0, 16, 4))
        texts.append(f"paid {n} on {datetime.date(1900, 1, 1) + datetime.timedelta(int(rng.integers(0, 73_049)))}, word {k}")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymised(docs(spark, list(enumerate(texts))), KEY).collect()}
    assert all(got[k] == by_rows(t) for k, t in enumerate(texts))


# -- quality classifier ------------------------------------------------------------------------------------------------


def corpus(spark, n=300):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(n):
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(rng.integers(20, 80))]
        rows.append((k, " ".join(words) + "." if k % 3 else " ".join([words[0]] * 40), 1 if k % 3 else 0))
    return docs(spark, [(k, t) for k, t, _ in rows]), spark.createDataFrame([(k, q, 0) for k, _, q in rows], "doc_id long, quality int, toxic int")


def test_quality_holds_on_held_out_rows(spark):
    df, labels = corpus(spark)
    trees = quality.train(df, labels)
    out = quality.scored(df, trees, "s").withColumn("out", quality.held_out("doc_id")).join(labels, "doc_id").collect()
    held = [r for r in out if r["out"]]
    assert 20 < len(held) < 120
    assert all((r["s"] >= quality.THRESHOLD) == (r["quality"] == 1) for r in held)
    assert quality.good(df, labels).columns == df.columns
    again = quality.train(df.repartition(7), labels.repartition(3))
    assert np.array_equal(trees.leaf, again.leaf)


def test_quality_never_learns_from_held_out_rows(spark):
    df, labels = corpus(spark, 120)
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(df, labels), quality.train(df, turned)
    assert np.array_equal(a.leaf, b.leaf) and np.array_equal(a.threshold, b.threshold)


def test_quality_trees_by_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    t = quality.fit(x, y, trees=30)
    assert ((t.score(x) > 0.5) == y).mean() > 0.9

    def walk(row):
        total = t.base
        for f, thr, leaf in zip(t.feature, t.threshold, t.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > thr[at])
            total += leaf[at - len(f)]
        return total

    assert np.allclose(t.margin(x[:50]), [walk(r) for r in x[:50]])


def test_quality_odd_rows(spark):
    df, labels = corpus(spark, 60)
    none = labels.limit(0)
    for trees in (quality.train(df, none), quality.train(df, labels.where("quality = 1")), quality.train(df.limit(0), labels)):
        got = quality.scored(docs(spark, ODD), trees).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    odd_labels = labels.union(spark.createDataFrame([(None, 1, 0), (5, None, None), (7, 1, 1), (99999, 0, 0)], labels.schema))
    assert quality.scored(docs(spark, []), quality.train(df, odd_labels)).count() == 0
    assert quality.statistics(None) == quality.statistics("") == [0.0] * len(quality.FEATURES)
    assert all(np.isfinite(quality.statistics(t)).all() for t in (" ", "\n\n", "x", "😀", "a\ud800"))
