"""Reading code by character: quotes, brackets, arguments, statements."""

from __future__ import annotations

import re
from collections.abc import Iterator

_OPEN, _CLOSE = "([{", ")]}"
_NAME = re.compile(r"[A-Za-z_]\w*")
_DOTTED = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*")
_WRAPPED = re.compile(r"([A-Za-z_]\w*)\((.*)\)", re.S)


def outside_quotes(text: str, quotes: str = "'\"`") -> Iterator[tuple[int, str, bool]]:
    """``(index, character, code)`` of each character; ``code`` is false within string literals and for their quotes."""
    quote, skip = "", False
    for i, c in enumerate(text):
        if quote:
            yield i, c, False
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == quote:
                quote = ""
        else:
            if c in quotes:
                quote = c
            yield i, c, c not in quotes


def split_arguments(text: str) -> list[str]:
    """Arguments of a call: cut at commas outside quotes and parentheses; blank ones are dropped."""
    out, start, depth = [], 0, 0
    for i, c, code in outside_quotes(text):
        if not code:
            continue
        if c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    out.append(text[start:])
    return [a.strip() for a in out if a.strip()]


def call_arguments(snippet: str) -> list[str]:
    """Arguments between the first opening and the last closing parenthesis."""
    a, b = snippet.find("("), snippet.rfind(")")
    return split_arguments(snippet[a + 1 : b]) if 0 <= a < b else []


def unwrap(expression: str, which: int) -> tuple[str, list[str]]:
    """A name inside calls that wrap it, following the argument ``which`` (0: first, -1: last), and the wrappers."""
    now, wrappers = expression.strip().rstrip(";").strip(), []
    while m := _WRAPPED.fullmatch(now):
        inner = split_arguments(m[2])
        if not inner:
            break
        wrappers.append(m[1])
        now = inner[which].strip()
    return now, wrappers


def handler_hint(snippet: str) -> str | None:
    """The name that the last argument of a route call stands for; wrappers are taken off by their first argument."""
    args = call_arguments(" ".join(snippet.split()))
    if len(args) < 2:
        return None
    name, _ = unwrap(args[-1], 0)
    return name if _DOTTED.fullmatch(name) else None


def handler_candidates(hint: str | None) -> list[tuple[int, str, list[str]]]:
    """``(position, name, wrappers)`` of everything in a hint that may be a handler; the last is the likeliest."""
    parts = split_arguments(hint or "")
    found = []
    for i, part in enumerate(parts):
        name, wrappers = unwrap(part, -1)
        if _DOTTED.fullmatch(name):
            found.append((i, name, wrappers))
    return found


def without_noise(text: str) -> str:
    """Code without string contents and comments; expressions inside template literals stay."""
    pattern = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\])*'?|\"(?:\\.|[^\"\\])*\"?|`(?:[^`])*`?", re.S)

    def blank(m: re.Match) -> str:
        if m[0].startswith("`"):
            return " " + " ".join(re.findall(r"\$\{([^}]*)\}?", m[0])) + " "
        return " "

    return pattern.sub(blank, text)


def called_names(text: str) -> list[str]:
    """Names that a statement calls, in order; keywords and all-capital names are none."""
    names = re.findall(r"\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)\s*\(", without_noise(text))
    return [n for n in names if n not in ("if", "for", "while", "switch", "return", "new") and not n.isupper()]


#: Calls that lead nowhere worth following.
_DEAD_ENDS = ("res.", "response.", "db.", "console.", "logger.", "math.", "json.", "string.")


def is_followable(name: str) -> bool:
    return not name.lower().startswith(_DEAD_ENDS) and name.lower() not in ("status", "send", "json", "query")


def block_end(lines: list[str], start: int) -> int | None:
    """Line (from 1) on which the first block that opens at line ``start`` or later closes."""
    text = "\n".join(lines[start - 1 :])
    line, depth, opened = start, 0, False
    for _, c, code in outside_quotes(text):
        if c == "\n":
            line += 1
        elif code and c == "{":
            depth, opened = depth + 1, True
        elif code and c == "}":
            depth -= 1
            if opened and not depth:
                return line
    return None


def split_statements(lines: list[str], first: int) -> list[tuple[int, int, str]]:
    """``(first line, last line, text)`` of the statements in a body whose lines begin at number ``first``.

    A statement ends at a semicolon outside brackets, after a line ``if … return …``, and after a ``return`` that needs no
    more. Comments are no statements.
    """
    out: list[tuple[int, int, str]] = []
    held: list[str] = []
    start, depth, quote, skip = None, 0, "", False

    def flush(last: int) -> None:
        nonlocal held, start
        text = " ".join(" ".join(held).split())
        if text and start is not None and not text.startswith(("//", "/*")):
            out.append((start, last, text))
        held, start = [], None

    for number, line in enumerate(lines, first):
        bare = line.strip()
        if not bare:
            continue
        start = number if start is None else start
        held.append(line)
        for c in line:
            if quote:
                if skip:
                    skip = False
                elif c == "\\":
                    skip = True
                elif c == quote:
                    quote = ""
            elif c in "'\"`":
                quote = c
            elif c in _OPEN:
                depth += 1
            elif c in _CLOSE:
                depth = max(0, depth - 1)
            elif c == ";" and not depth:
                flush(number)
        done = bare.startswith("if ") and "return " in bare or bare.startswith("return ") and not bare.endswith(";")
        if not depth and done:
            flush(number)
    if held:
        flush(first + len(lines) - 1)
    return out
