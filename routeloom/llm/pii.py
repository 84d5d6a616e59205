"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, colons, digits, URL schemes, and cues of identifiers, secrets and streets.
At each, a deterministic local parser expands to the boundaries and validates. Each parser
moves forward only, so a text costs time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from routeloom.llm.common import documents, small_arrow_batches

#: Kinds in the order that spans with one start take; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "account", "ssn", "url", "ipv6", "secret", "postal")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+")
_IBAN = re.compile(r"[\x20:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:\x20(?:number|no\.?|nr\.?))?[\x20:#]{1,3}([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])", re.I)
_SSN = re.compile(r"[\x20:#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_URL = re.compile(r"(?:[^\s/@<>\"']+@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")

_HEX = frozenset("0123456789abcdefABCDEF:")
_VALUE = re.compile(r"(?:[A-Za-z0-9]?[_-][A-Za-z0-9_-]{0,20})?[\"']?[\x20\t]{0,3}(?:=>|[=:])[\x20\t]{0,3}([\"']?)([A-Za-z0-9+/_.=~-]{8,})")
_KEY = re.compile(r"[A-Za-z0-9_-]{16,}")
_PRIVATE = re.compile(r"[A-Z\x20]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z\x20]{0,20}PRIVATE KEY-----)?")
_HOUSE = re.compile(r"(?<![A-Za-z0-9])([0-9]{1,5}[A-Za-z]?(?:\x20[A-Z][A-Za-z.'-]{0,20}){1,4}\x20)\Z")
_TOWN = re.compile(r"(?:,?\x20[A-Z][A-Za-z.'-]{1,20}){1,3},?\x20(?:[A-Z]{2}\x20)?[0-9]{5}(?:-[0-9]{4})?(?![0-9])")

#: Characters of an IBAN by country (fixed values of the registry).
_IBAN_LENGTHS = {
    c: int(n)
    for n, countries in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL "
        "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV "
        "29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split())
    for c in countries.split(",")
}

_CUES = {"iban": _IBAN, "account": _ACCOUNT, "acct": _ACCOUNT, "ssn": _SSN, "social security": _SSN}
_CUE_KIND = {_IBAN: "iban", _ACCOUNT: "account", _SSN: "ssn"}
_SCHEMES = ("http://", "https://", "ftp://")
#: Names of secrets before an equals sign or a colon, beginnings of keys that issuers give, and words for streets.
_SECRET_NAMES = ("token", "password", "passwd", "secret", "api_key", "api-key", "apikey", "access_key", "client_secret")
_KEY_STARTS = ("AKIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-")
_STREETS = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive")


def _automaton() -> ahocorasick.Automaton:
    anchors = ahocorasick.Automaton()
    for c in "@+:0123456789":
        anchors.add_word(c, (c if c in "@+:" else "0", 1))
    for name in _SECRET_NAMES:
        for form in (name, name.upper(), name.capitalize()):
            anchors.add_word(form, ("secret", len(name)))
    for start in _KEY_STARTS:
        anchors.add_word(start, ("key", len(start)))
    anchors.add_word("-----BEGIN ", ("private", 11))
    for street in _STREETS:
        anchors.add_word(street, ("street", len(street)))
    for s in _SCHEMES:
        for form in (s, s.upper()):
            anchors.add_word(form, ("url", len(s)))
    for cue in _CUES:
        for form in (cue, cue.upper(), cue.title(), cue.capitalize()):
            anchors.add_word(form, (cue, len(cue)))
    anchors.make_automaton()
    return anchors


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _iban_end(text: str, start: int, stop: int) -> int | None:
    """Where the IBAN from ``start`` ends, at ``stop`` or before: at its country's length; of a country unknown, at the last group that validates."""
    wanted, n, ends = _IBAN_LENGTHS.get(text[start : start + 2]), 0, []
    for i in range(start, stop):
        n += text[i] != " "
        after = text[i + 1 : i + 2]
        if text[i] != " " and n == (wanted or max(n, 15)) and not (after.isascii() and after.isalnum()):
            ends.append(i + 1)
    return next((end for end in reversed(ends) if _iban_ok(text[start:end])), None)


def _ipv6(text: str, at: int, low: int) -> tuple[int, int | None]:
    """The run of hexadecimal digits and colons around ``at``, from ``low`` on: where it ends, and where it begins if it is an address."""
    start, stop = at, at + 1
    while start > low and text[start - 1] in _HEX:
        start -= 1
    while stop < len(text) and text[stop] in _HEX:
        stop += 1
    run = text[start:stop]
    alone = not (text[start - 1 : start].isalnum() or text[stop : stop + 1].isalnum())
    if not (alone and run.count(":") >= 2 and len(run) <= 39 and sum(c != ":" for c in run) >= 4):
        return stop, None
    try:
        ipaddress.IPv6Address(run)
    except ValueError:
        return stop, None
    return stop, start


def _looks_secret(value: str, quoted: bool) -> bool:
    return any(map(str.isdigit, value)) and any(map(str.isalpha, value)) and (quoted or len(value) >= 16)


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start and then kind; ends are exclusive.

    Base kinds are leftmost and non-overlapping within their kind; a match that fails its validation is dropped, and not tried again.
    """
    found = []
    email = ip = card = phone = url = ipv6 = secret = 0  # each parser has read up to here
    for end, (kind, size) in _ANCHORS.iter(text):
        at = end + 1 - size
        if kind == "0":
            if at >= card:
                m = _CARD.match(text, at)
                card = m.end() if m else at + 1
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.append(("card", at, card))
            if at >= ip:
                m = _IP.match(text, at)
                ip = m.end() if m else _DIGITS.match(text, at).end()
                if m and all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                    found.append(("ip", at, ip))
        elif kind == "@":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                email = m.end()
                found.append(("email", start, email))
        elif kind == "+":
            m = _PHONE.match(text, at) if at >= phone else None
            if m:
                run = m[0].rstrip(" ().-")
                if len(run) >= 4:
                    phone = at + len(run)
                    if 10 <= sum(c.isdigit() for c in run) <= 15:
                        found.append(("phone", at, phone))
        elif kind == "url":
            m = _URL.match(text, end + 1) if at >= url else None
            if m:
                stop = end + 1 + len(m[0].rstrip(".,;:!?)"))
                found.append(("url", at, stop))
                url = stop
        elif kind == ":":
            if at >= ipv6:
                ipv6, begin = _ipv6(text, at, ipv6)
                if begin is not None:
                    found.append(("ipv6", begin, ipv6))
        elif kind == "secret":
            m = _VALUE.match(text, end + 1) if at >= secret else None
            if m and _looks_secret(m[2], bool(m[1])):
                secret = m.end(2)
                found.append(("secret", m.start(2), secret))
        elif kind == "key":
            m = _KEY.match(text, end + 1) if at >= secret and not text[at - 1 : at].isalnum() else None
            if m and _looks_secret(m[0], True):
                secret = m.end()
                found.append(("secret", at, secret))
        elif kind == "private":
            m = _PRIVATE.match(text, end + 1) if at >= secret else None
            if m:
                secret = m.end()
                found.append(("secret", at, secret))
        elif kind == "street":
            m = _HOUSE.search(text[max(0, at - 100) : at])
            if m and not text[end + 1 : end + 2].isalnum():
                town = _TOWN.match(text, end + 1)
                found.append(("postal", at - len(m[1]), town.end() if town else end + 1))
        elif m := _CUES[kind].match(text, end + 1):
            what = _CUE_KIND[_CUES[kind]]
            stop = _iban_end(text, *m.span(1)) if what == "iban" else m.end(1)
            if stop:
                found.append((what, m.start(1), stop))
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data and secrets, per row of ``docs``: ``id_col, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256``, ``spans`` (all), ``n_spans``.

    Null and empty texts have no spans: counts 0, the digest of the empty string, an empty string, 0. Null ids stay
    null; repeated rows are kept; other columns are ignored.
    """
    small_arrow_batches(docs.sparkSession)
    names = [id_col, *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"]
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, all_spans, sizes = [[] for _ in BASE], [], [], []
            for value in batch.column(1):
                spans = find_spans(value.as_py() or "")
                base = [s for s in spans if s[0] in BASE]
                for n, k in zip(counts, BASE, strict=True):
                    n.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                all_spans.append(joined(spans))
                sizes.append(len(spans))
            arrays = [*(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(all_spans, pa.string()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    kinds = [id_type, *["long"] * len(BASE), "string", "string", "long"]
    return docs.select(id_col, text_col).mapInArrow(scan, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def query(spark, sf_dir):
    """Personal data in every document."""
    return find_personal_data(documents(spark, sf_dir))


def base_counts(spark, sf_dir):
    """Numbers of base spans in every document."""
    return find_personal_data(documents(spark, sf_dir)).select("doc_id", *[f"n_{k}" for k in BASE])


#: The same numbers, by the patterns of the base kinds.
BASE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
m AS (SELECT doc_id, len(regexp_extract_all(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email, regexp_extract_all(x, '[0-9]+(?:\.[0-9]+){3}') AS ips,
  regexp_extract_all(x, '[0-9](?:[ -]?[0-9])+') AS cards, regexp_extract_all(x, '\+[0-9][ ().0-9-]+[0-9]') AS phones FROM t)
SELECT doc_id, n_email::BIGINT AS n_email, len(list_filter(ips, lambda i: len(list_filter(string_split(i, '.'), lambda p: len(ltrim(p, '0')) > 3 OR (ltrim(p, '0') <> '' AND ltrim(p, '0')[1:3]::INT > 255))) = 0))::BIGINT AS n_ip,
  len(list_filter(list_transform(cards, lambda c: regexp_replace(c, '[ -]', '', 'g')), lambda d: len(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, len(d) + 1),
    lambda i: CASE WHEN i % 2 = 1 THEN d[len(d) - i + 1]::INT WHEN d[len(d) - i + 1]::INT > 4 THEN 2 * d[len(d) - i + 1]::INT - 9 ELSE 2 * d[len(d) - i + 1]::INT END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phones, lambda p: len(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 10 AND 15))::BIGINT AS n_phone
FROM m"""
