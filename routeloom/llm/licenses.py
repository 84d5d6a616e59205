"""License scans by sentence rules, with DataFrame functions only.

A text is normalised and cut into sentences, over single line ends too; each is mapped to the identifier of a known
licence sentence; the identifiers, in order, are matched against ordered licence rules, which consume them from the left. All of it happens
within a row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.llm.common import documents

#: Known licence sentences by identifier, normalised (lower case, letters and digits, single spaces); "|" is a stop within one.
SENTENCES = {
    "apache2-notice": "licensed under the apache license version 2 0",
    "apache2-notice-the": "licensed under the apache license version 2 0 the license",
    "apache2-use": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-url": "http www apache org licenses license 2 0",
    "apache2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-notice-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-short": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-notice-short": "licensed under the gnu general public license version 3",
    "gpl2-notice": "licensed under the gnu general public license version 2",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advertise": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v| 2 0",
    "mpl2-obtain": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "epl2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "epl2-notice-at": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl2-notice-v": "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-notice": "distributed under the boost software license version 1 0",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-nc-4-work": "this work is licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-4-work": "this work is licensed under cc by 4 0",
    "cc-by-4-full": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "cc-by-sa-4-work": "this work is licensed under cc by sa 4 0",
    "cc-by-sa-4-full": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0": "released under cc0 1 0",
}

#: The licences of the GNU family: (licence, its name in sentences, versions).
_GNU = (("GPL", "gnu general public license", ("2", "3")), ("LGPL", "gnu lesser general public license", ("2 1", "3")), ("AGPL", "gnu affero general public license", ("3",)))

#: Ordered rules: (licence, sequence of identifiers). From the left, the first rule that fits consumes its identifiers, so a longer
#: rule, which comes first, hides those that it holds.
RULES = [
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertise")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("Apache-2.0", ("apache2-notice-the", "apache2-use", "apache2-copy", "apache2-url", "apache2-basis", "apache2-see")),
    ("Apache-2.0", ("apache2-notice-the", "apache2-use", "apache2-copy", "apache2-basis", "apache2-see")),
    ("Apache-2.0", ("apache2-notice-the", "apache2-use")),
    ("MPL-2.0", ("mpl2-notice", "mpl2-obtain")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")),
    ("Apache-2.0", ("apache2-notice",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-licensed",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0", ("gpl3-notice-short",)),
    ("GPL-2.0", ("gpl2-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-full",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-4-work",)),
    ("CC-BY-4.0", ("cc-by-4-full",)),
    ("CC0-1.0", ("cc0",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("EPL-2.0", ("epl2-notice-at",)),
    ("EPL-2.0", ("epl2-notice-v",)),
    ("Unlicense", ("unlicense-free",)),
    ("BSL-1.0", ("boost-notice",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-title-short",)),
]


def _gnu() -> None:
    """Sentences and rules of the GNU family, which follow one form."""
    long, short = [], []
    for name, said, versions in _GNU:
        low = name.lower()
        for what in ("program", "library"):
            warranty, see = f"{low}-warranty-{what}", f"{low}-see"
            SENTENCES[warranty] = f"this {what} is distributed in the hope that it will be useful but without any warranty| without even the implied warranty of merchantability or fitness for a particular purpose"
            SENTENCES[see] = f"see the {said} for more details"
            for v in versions:
                start = f"this {what} is free software| you can redistribute it and or modify it under the terms of the {said}"
                forms = {
                    "": f"{start} as published by the free software foundation| either version {v} of the license or at your option any later version",
                    "-only": f"{start} version {v} as published by the free software foundation",
                    "-only-of": f"{start} as published by the free software foundation| version {v} of the license",
                }
                for form, text in forms.items():
                    found = f"{low}{v.replace(' ', '')}-{what}{form}"
                    SENTENCES[found] = text
                    number = v.replace(" ", ".") if " " in v else f"{v}.0"
                    licence = f"{name}-{number}" + ("-only" if form else "")
                    long += [(licence, (found, warranty, see)), (licence, (found, warranty))]
                    short.append((licence, (found,)))
    # one sentence says the same for the whole family
    same = {}
    for i, text in list(SENTENCES.items()):
        if same.setdefault(text, i) != i:
            del SENTENCES[i]
    keep = lambda seq: tuple(i if i in SENTENCES else next(k for k in SENTENCES if k.endswith(i.split("-", 1)[1])) for i in seq)
    RULES[:0] = [(name, keep(seq)) for name, seq in long]
    RULES.extend((name, keep(seq)) for name, seq in short)


_gnu()

#: Licences that an SPDX line may name; others are reported as they stand there.
SPDX = (
    "0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause",
    "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0",
    "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-1.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT",
    "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "PSF-2.0", "Unlicense", "UPL-1.0", "W3C", "WTFPL", "X11", "Zlib",
)

#: Every known sentence holds one of these; texts without any need no cutting.
TRIGGER = "(?i)(?:licen|permi|warrant|redistrib|cc0|copyright|unencumbered|anyone is free|held liable|liability|all advertising|neither the name|obtain one at)"

#: Stops before white space or the end: sentences end there, at blank lines, and may end at any other line end.
_END = r"[.;:!?]+([\x20\x09-\x0D]|\z)"

_OUT = ("n_sentences", "sentence_ids", "licenses", "license")
_SPDX_LINE = "spdx license identifier"

#: How a text is normalised: (pattern, replacement), in this order, on its lower case.
_STEPS = (
    ("\r\n?", "\n"),
    ("spdx-license-identifier:[ \t]*", f"{_SPDX_LINE} "),
    (r"(?m)^[^a-z0-9\n]+", ""),  # comment marks
    (_END, "\n\n"),
    (r"[^a-z0-9\n]+", " "),
    (" ?\n ?", "\n"),
)


def _pattern(sentence: str) -> str:
    return sentence.replace("https ", "http ").replace("http ", "https? ").replace("| ", "(?:[ \n]|\n\n\n?)").replace(" ", "[ \n]").replace("[[ \n]\n]", "[ \n]")


def _plain(sentence: str) -> str:
    return sentence.replace("|", "").replace("https ", "http ")


#: A known sentence over whole lines, the longest that fits. Blank lines and stops are two line ends, so it does not reach over them.
_KNOWN = "(?m)^(?:" + "|".join([f"{_SPDX_LINE} [a-z0-9 ]+", *map(_pattern, sorted(SENTENCES.values(), key=len, reverse=True))]) + ")$"
#: The identifiers that a rule consumes, each in angle brackets; an SPDX line is a rule of its own.
_RULE = "|".join(["<spdx:[a-z0-9-]+>", *("".join(f"<{i}>" for i in seq) for _, seq in RULES)])


def _key(name: str) -> str:
    return "spdx:" + name.lower().replace(".", "-")


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order. A sentence may be wrapped over lines, each with comment marks before it.
    An SPDX line's is ``spdx:`` and what it names."""
    plain = F.lower(text)
    for pattern, to in _STEPS:
        plain = F.regexp_replace(plain, pattern, to)
    found = F.regexp_extract_all(plain, F.lit(_KNOWN), F.lit(0))
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (_plain(s), i)])
    named = lambda s: F.concat(F.lit("spdx:"), F.replace(F.substring(s, len(_SPDX_LINE) + 2, 1_000), F.lit(" "), F.lit("-")))
    flat = F.transform(found, lambda s: F.regexp_replace(F.regexp_replace(s, "\n+", " "), "https ", "http "))
    return F.transform(flat, lambda s: F.when(s.startswith(_SPDX_LINE), named(s)).otherwise(F.try_element_at(known, s)))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with

    * ``n_sentences`` (long): known licence sentences found, repeats counted;
    * ``sentence_ids``: their identifiers in order, comma-joined;
    * ``licenses``: the licences found, comma-joined, in the order in which rules consumed the text's identifiers; each once;
    * ``license``: the first of them, or null.

    A licence that an SPDX line names and :data:`SPDX` does not know is ``SPDX:`` and its words; an expression of several is one.
    Null and empty texts: 0, two empty strings, null. Rows are independent; repeated rows are kept.
    Input columns with the name of an output column are replaced.
    """
    text = F.col(f"`{text_col}`")
    none = F.array().cast("array<string>")
    ids = F.when(text.rlike(TRIGGER), sentence_ids(text)).otherwise(none)
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in _OUT], ids.alias("_rl_ids"))
    bracketed = F.concat(F.lit("<"), F.array_join("_rl_ids", "><"), F.lit(">"))
    names = F.create_map(*[F.lit(x) for name, seq in RULES for x in ("".join(f"<{i}>" for i in seq), name)], *[F.lit(x) for n in SPDX for x in (f"<{_key(n)}>", n)])
    other = lambda m: F.concat(F.lit("SPDX:"), F.substring(m, 7, 1_000))
    consumed = F.transform(F.regexp_extract_all(bracketed, F.lit(_RULE), F.lit(0)), lambda m: F.coalesce(F.try_element_at(names, m), F.replace(other(m), F.lit(">"), F.lit(""))))
    return (
        rows.withColumn("_rl_found", F.when(F.size("_rl_ids") > 0, F.array_distinct(consumed)).otherwise(none))
        .withColumn("n_sentences", F.size("_rl_ids").cast("long"))
        .withColumn("sentence_ids", F.array_join("_rl_ids", ","))
        .withColumn("licenses", F.array_join("_rl_found", ","))
        .withColumn("license", F.try_element_at("_rl_found", F.lit(1)))
        .drop("_rl_ids", "_rl_found")
    )


def query(spark, sf_dir):
    """Licences of every document."""
    return scan_licenses(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def _sql() -> str:
    """The same over one sentence a row: it is cut by the stops and blank lines, and a known sentence is sought from each line on."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    plain = "lower(coalesce(text, ''))"
    for pattern, to in _STEPS:
        plain = f"regexp_replace({plain}, {quote(pattern)}, {quote(to)}, 'g')"
    known = ", ".join(f"({quote(_plain(s))}, {quote(i)})" for i, s in SENTENCES.items())
    rules = ", ".join(f"({quote(''.join(f'<{i}>' for i in seq))}, {quote(name)})" for name, seq in RULES)
    rules += ", " + ", ".join(f"({quote(f'<{_key(n)}>')}, {quote(n)})" for n in SPDX)
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
rules(seq, name) AS (VALUES {rules}),
docs AS (SELECT row_number() OVER () AS r, doc_id, {plain} AS t FROM documents),
cut AS (SELECT r, unnest(regexp_extract_all(t, {quote(_KNOWN)})) AS s, generate_subscripts(regexp_extract_all(t, {quote(_KNOWN)}), 1) AS pos FROM docs
        WHERE regexp_matches(t, {quote(TRIGGER.removeprefix('(?i)'))})),
flat AS (SELECT r, pos, replace(regexp_replace(s, '\n+', ' ', 'g'), 'https ', 'http ') AS s FROM cut),
ids AS (
  SELECT r, string_agg(coalesce(id, 'spdx:' || replace(s[{len(_SPDX_LINE) + 2}:], ' ', '-')), ',' ORDER BY pos) AS ids, count(*) AS n
  FROM flat LEFT JOIN known ON known.sentence = s GROUP BY r),
eaten AS (
  SELECT r, unnest(m) AS m, generate_subscripts(m, 1) AS pos
  FROM (SELECT r, regexp_extract_all('<' || replace(ids, ',', '><') || '>', {quote(_RULE)}) AS m FROM ids)),
hit AS (SELECT r, coalesce(name, 'SPDX:' || m[7:len(m) - 1]) AS name, min(pos) AS pos FROM eaten LEFT JOIN rules ON seq = m GROUP BY ALL),
found AS (SELECT r, string_agg(name, ',' ORDER BY pos) AS licenses, arg_min(name, pos) AS license FROM hit GROUP BY r)
SELECT d.doc_id, coalesce(ids.n, 0)::BIGINT AS n_sentences, coalesce(ids.ids, '') AS sentence_ids,
       coalesce(found.licenses, '') AS licenses, found.license
FROM docs d LEFT JOIN ids USING (r) LEFT JOIN found USING (r)
"""


SQL = _sql()
