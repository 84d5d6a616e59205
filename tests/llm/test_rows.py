"""Operators that look at one row at a time, against plain definitions."""

import base64
import hashlib
import random
import re
import string
import textwrap
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routeloom.llm import chat, licenses, pii, quality_rules

from .cases import SCHEMA, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    ws = WORD.findall(text)
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {j for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n#|\u3000\x1c", max_size=120))
def test_base_counts(text):
    assert quality_rules.base_counts(text) == plain_counts(text)


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="019.+@- ()aZé_", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert [s for s in pii.find_spans(text) if s[0] in pii.BASE] == plain_spans(text)


@pytest.mark.parametrize(
    "text",
    ["card 4111 1111 1111 1111 and 4111-1111-1111-1112", "a.b@c.d@e.f.g", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "+1 (017) 555-7713 +1 (0", "x@y", "é@a.b"],
)
def test_base_spans_examples(text):
    assert [s for s in pii.find_spans(text) if s[0] in pii.BASE] == plain_spans(text)


def test_numbers_of_any_length():
    long = "0" * 5_000
    assert pii.find_spans(f"1.2.3.{long}7") == [("ip", 0, 5007)]
    assert pii.find_spans(f"1.2.3.9{long}") == [] and pii.find_spans(f"{'9' * 5_000}.1.1.1") == []


def test_added_spans():
    text = "see HTTPS://ann@site.example/x, IBAN: DE89 3704 0044 0532 0130 00; account no. 12-3456-789. SSN 078-05-1120"
    got = {(k, text[a:b]) for k, a, b in pii.find_spans(text) if k not in pii.BASE}
    assert got == {("url", "HTTPS://ann@site.example/x"), ("iban", "DE89 3704 0044 0532 0130 00"), ("account", "12-3456-789"), ("ssn", "078-05-1120")}
    assert not pii.find_spans("IBAN DE00 3704 0044 0532 0130 00 none")


def test_iban_ends_before_what_follows():
    valid = lambda v: int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    german = "DE89370400440532013000"
    more = next(f"{k:02}" for k in range(100) if valid(f"{german}{k:02}"))  # validates too, but is too long
    unknown = next(v for k in range(100) if valid(v := f"ZZ{k:02}12345678901234"))
    for iban, rest in (
        (german, " BIC COBADEFFXXX"), ("DE89 3704 0044 0532 0130 00", " OK"), (german, " " + more), (german, ", 12"), (german, " Ok"), (german, ""),
        ("GB82 WEST 1234 5698 7654 32", " 2024 AND MORE UPPER CASE WORDS"), ("NO93 8601 1117 947", " 77"), (unknown, " BICX"),
    ):
        text = f"IBAN {iban}{rest}"
        assert [text[a:b] for k, a, b in pii.find_spans(text) if k == "iban"] == [iban], text
    assert not [s for s in pii.find_spans(f"IBAN {german}BIC, IBAN DE89370400440532013001 BIC") if s[0] == "iban"]


def test_compression_bands():
    import os

    rng = random.Random(1)
    syllables = ["the", "an", "ti", "on", "re", "st", "ing", "ou", "ble", "ha", "er", "nd"]
    words = " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(4000))
    assert quality_rules.in_bands(words.encode()) and quality_rules.in_bands(b"")
    assert not quality_rules.in_bands(b"all the same " * 400)
    assert not quality_rules.in_bands(os.urandom(20_000))
    half = words.encode()[:20_000] + os.urandom(12_000)
    assert not quality_rules.in_bands(half)  # the chunks tell


def prose_like(rng, size):
    syllables = ["the", "an", "ti", "on", "re", "st", "ing", "ou", "ble", "ha", "er", "nd"]
    return " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(size)).encode()[:size]


def base64_like(rng, size):
    return base64.b64encode(rng.randbytes(size))[:size]


def test_bands_reject_base64_and_random_letters():
    rng = random.Random(3)
    letters = " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randrange(3, 10))) for _ in range(8_000)).encode()
    assert not any(quality_rules.in_bands(letters[:n]) for n in (1_000, 1_500, 3_000, 4_096, 12_000, 45_000))
    assert not any(quality_rules.in_bands(base64_like(rng, n)) for n in (400, 1_000, 3_500, 8_192, 40_000))
    for good, bad in ((20_480, 20_480), (8_192, 24_576)):
        assert quality_rules.in_bands(prose_like(rng, good))
        assert not quality_rules.in_bands(prose_like(rng, good) + base64_like(rng, bad))


def test_bands_see_every_chunk():
    rng = random.Random(4)
    for good, bad in ((4_096, 4_095), (4_096, 2_000), (4_000, 600), (8_192, 4_095), (8_192, 400), (30_720, 10_240)):
        text = prose_like(rng, good + bad)
        assert quality_rules.in_bands(text)
        assert not quality_rules.in_bands(text[:good] + base64_like(rng, bad)), (good, bad)
    assert not quality_rules.in_bands(base64_like(rng, 4_096) + prose_like(rng, 36_864))


def test_rules_and_personal_data_on_odd_rows(spark):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, quality_rules.apply_rules(docs).select("doc_id", "n_words", "n_repeat_words", "base_failed").collect()), key=str)
    want = []
    for r in rows:
        n, _, _, _, rep = plain_counts(r[1] or "")
        want.append((r[0], n, rep, n < 10 or 100 * rep > 20 * n))
    assert got == sorted(want, key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_rules.apply_rules(empty).count() == 0 and pii.find_personal_data(empty).count() == 0
    found = pii.find_personal_data(docs)
    assert found.count() == len(rows)
    assert {r["base_sha256"] for r in found.collect()} == {hashlib.sha256(b"").hexdigest()}


def test_sentences_hold_the_trigger():
    assert all(re.search(licenses.TRIGGER, s) for s in licenses.SENTENCES.values())
    assert {i for _, seq in licenses.RULES for i in seq} == set(licenses.SENTENCES)
    assert all(i in licenses.SENTENCES for _, seq in licenses.RULES for i in seq)


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [
        (1, "x.\nLicensed under the Apache License, Version 2.0.", 1),
        (2, mit, 1),
        (3, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 1),
        (4, "Released under the MIT License. LICENSED UNDER CC BY-NC 4.0!\r\nReleased under the MIT license", 1),
        (5, None, 1),
        (None, "", 1),
        (6, "A license to say nothing.", None),
    ]
    got = {(r["doc_id"], r["n_sentences"], r["licenses"], r["license"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license long")).collect()}
    assert got == {
        (1, 1, "Apache-2.0", "Apache-2.0"), (2, 2, "MIT", "MIT"), (3, 1, "", None), (4, 3, "MIT,CC-BY-NC-4.0", "MIT"),
        (5, 0, "", None), (None, 0, "", None), (6, 0, "", None),
    }
    plan = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, x long"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."


GPL2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""
GPL2_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""
AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
WHOLE = [
    ("MIT", MIT), ("BSD-3-Clause", BSD), ("BSD-2-Clause", BSD.split("\n\n3.")[0]), ("GPL-3.0", GPL), ("GPL-2.0", GPL2), ("GPL-2.0-only", GPL2_ONLY), ("LGPL-2.1", LGPL),
    ("AGPL-3.0", AGPL), ("Apache-2.0", APACHE), ("ISC", ISC), ("MPL-2.0", MPL), ("EPL-2.0", EPL), ("Zlib", ZLIB), ("Unlicense", UNLICENSE),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"), ("SPDX:mit-or-x-2", "SPDX-License-Identifier: MIT OR X-2"),
]


@pytest.mark.parametrize("mark", ["", " * ", ";; ", "# ", "// "])
def test_wrapped_licenses(spark, mark):
    """Texts as files have them give exactly their licence, and the SQL says the same."""
    wrapped = lambda s: "\n".join(mark + x for p in s.split("\n") for x in textwrap.wrap(p, 72 - len(mark), break_on_hyphens=False) or [""])
    forms = (str, wrapped, lambda s: wrapped(s).replace("\n", "\r\n"), lambda s: f"/*\n{wrapped(s)}\n */\nint main() {{}}\n")
    texts = [f(t) for _, t in WHOLE for f in forms]
    cut = wrapped("Released under the") + "\n" + mark.rstrip() + "\n" + mark + "MIT License"  # a blank line ends a sentence
    texts += [cut, wrapped("Released under the MIT License\nReleased under the MIT License\nand more"), wrapped(MIT) + "\n\n" + wrapped(BSD)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    for i, (name, _) in enumerate(WHOLE):
        assert [got[len(forms) * i + k]["licenses"] for k in range(len(forms))] == [name] * len(forms), (name, got[len(forms) * i])
    n = len(WHOLE) * len(forms)
    assert got[n]["sentence_ids"] == "mit-title-short" and got[n + 1]["sentence_ids"] == "mit-notice,mit-notice" and got[n + 2]["licenses"] == "MIT,BSD-3-Clause"
    assert as_sql(licenses.SQL, docs) == sorted(tuple(r) for r in licenses.scan_licenses(docs).drop("text").collect())


def as_sql(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return sorted(con.execute(sql).fetchall())


def test_license_of_long_and_no_text(spark):
    filler = "plain words without meaning\n" * 60_000
    rows = [(1, filler + MIT + "\n\n" + filler), (2, filler)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: ""}
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


CHATTY = st.lists(st.sampled_from(["</s>", "[INST] ", " [/INST]", "<<ROLE>>", "<</ROLE>>", "<s>", "\\", "a", " ", "\n", "user", "<", "[", "/"]), max_size=8).map("".join)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), CHATTY), CHATTY), max_size=5), st.integers(1, 9))
def test_round_trip(turns, step):
    text = "".join(chat.render_turn(r, t) for r, t in turns)
    parser, got = chat.Parser(), []
    for at in range(0, len(text), step):
        got += parser.feed(text[at : at + step])
    assert [t[:2] for t in got] == turns and parser.rest == ""


def test_plain_turns_are_not_escaped():
    assert chat.render_turn("user", "C:/x \\ ok") != chat.render_turn("user", "C:/x ok")
    assert chat.render_turn("user", "hello") == "[INST] hello [/INST]"
    assert chat.render_turn("assistant", "end\\") == "end\\</s>"


@pytest.mark.parametrize("kind", ["int", "bigint", "string", "smallint"])
def test_chat_ids_of_any_type(spark, kind):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", "c")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    turns = turns.withColumn("conv_id", turns["conv_id"].cast(kind))
    back = chat.read_back(chat.format_turns(turns))
    assert dict(back.dtypes)["conv_id"] == kind and {r["n_turns"] for r in back.collect()} == {1, 2}


def test_chat_digests(spark):
    rows = [
        (1, 1, "assistant", "b </s>", 0), (1, 0, "user", None, 0), (1, 1, "assistant", "b </s>", 0), (None, None, None, "x", 0), (2, 0, "system", "s", 0),
    ]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, frame long"))).collect()}
    said = "user\n\nassistant\nb </s>\nassistant\nb </s>\n"
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["loss_chars"] == 12 and got[1]["loss_sha256"] == hashlib.sha256(b"b </s>b </s>").hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\nx\n").hexdigest() and got[2]["loss_chars"] == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(none)).count() == 0
