"""Outbound calls to other services, read from the tokens of lines."""

from __future__ import annotations

import re

from routeloom.extract.syntax import Call, Token, calls, is_name, says, tokens

# What clients are called, what their calls are, and how routes are declared.
CLIENT_WORDS = {"client", "webclient", "requests", "httpx", "axios"}
CLIENT_STEPS = {"retrieve", "exchange", "uri"}
VERBS = ("get", "post", "put", "patch", "delete")
DECLARERS = ("app", "router", "blueprint", "bp")
MAPPING_ANNOTATIONS = ("getmapping", "postmapping", "putmapping", "deletemapping", "patchmapping", "requestmapping")
#: Lines that may follow the first of a call chain, and characters of a target.
MAX_FOLLOWING, MAX_TARGET = 6, 240


def is_declaration(line: str) -> bool:
    """Whether a line begins as the declaration of a route: a decorator, a mapping annotation, or a call on an application or a router."""
    words = tokens(line)
    if not words:
        return False
    if says(words, "@") and is_name(words, 1) and words[1].value.lower() in MAPPING_ANNOTATIONS:
        return True
    first = next(calls(words), None)
    if first is None or first.name.lower() not in (*VERBS, "route") or not first.receiver:
        return False
    return first.first == 1 if first.decorated else first.first == 0 and first.receiver.lower() in DECLARERS


def is_outbound(text: str) -> bool:
    """Whether a line speaks of a client: by its name, anywhere, or by a step that only clients have."""
    if CLIENT_WORDS.intersection(re.findall(r"\w+", text.lower())):
        return True
    return any(c.name.lower().endswith("fetch") or (c.after_dot and c.name.lower() in CLIENT_STEPS) for c in calls(tokens(text)))


def _starts_chain(line: str) -> bool:
    return any(c.after_dot and c.name.lower() in VERBS for c in calls(tokens(line))) and is_outbound(line) and not is_declaration(line)


def _goes_on(line: str) -> bool:
    return line.strip().startswith((".", ")", "})"))


def expressions(text: str) -> list[tuple[int, int, str]]:
    """``(first line, last line, text)``: each line, but a chain of calls on a client with the lines that carry it on as one."""
    lines = text.splitlines()
    out, covered = [], 0
    for i, line in enumerate(lines):
        if i < covered or not line.strip():
            continue
        covered = i + 1
        if _starts_chain(line):
            while covered < len(lines) and covered - i <= MAX_FOLLOWING and _goes_on(lines[covered]):
                covered += 1
        out.append((i + 1, covered, " ".join(x.strip() for x in lines[i:covered])))
    return out


def _function_name(words: list[Token]) -> str | None:
    """The function that a line begins: ``def f(``, ``async def f(``, ``function f(``, ``const f = … =>``."""
    if says(words, "async", "def"):
        words = words[1:]
    if (says(words, "def") or says(words, "function")) and is_name(words, 1) and says(words[2:], "("):
        return words[1].value
    if words and words[0].value in ("const", "let", "var") and is_name(words, 1) and says(words[2:], "=") and any(t.value == "=>" for t in words[3:]):
        return words[1].value
    return None


def enclosing_symbols(text: str) -> list[str | None]:
    """For each line, the function that begins on it or last before it."""
    now, out = None, []
    for line in text.splitlines():
        now = _function_name(tokens(line)) or now
        out.append(now)
    return out


def _uri(found: list[Call]) -> str | None:
    """The only argument of a step ``uri``, where it is a literal."""
    for c in found:
        if c.after_dot and c.name.lower() == "uri" and len(c.args) == 1 and len(c.args[0]) == 1 and (path := c.path()) and c.rest is not None and len(path) <= MAX_TARGET:
            return path
    return None


def outbound_calls(text: str) -> list[dict]:
    """``line, symbol, client, verb, target, form, raw`` of calls to other services. ``form``: ``chain`` (verb and ``uri(…)``),
    ``call`` (verb and a path or URL), ``method_only`` or ``path_only``. ``target`` is as written."""
    symbols, out = enclosing_symbols(text), []
    for first, _, expression in expressions(text):
        if not is_outbound(expression) or is_declaration(expression):
            continue
        words = tokens(expression)
        found = list(calls(words))
        client = next((c for c in found if c.receiver and c.name.lower() in VERBS), None)
        uri = _uri(found)
        said = (t.literal for t in words if t.kind == "text" and t.value[0] != "`" and len(t.literal) <= MAX_TARGET)
        target = uri or next((s for s in said if s.strip().startswith(("/", "http://", "https://"))), None)
        if not client and target is None:
            continue
        form = "chain" if client and uri else "call" if client and target else "method_only" if client else "path_only"
        out.append({"line": first, "symbol": symbols[first - 1], "client": client and client.receiver, "verb": client and client.name.lower(), "target": target, "form": form, "raw": expression})
    return out
