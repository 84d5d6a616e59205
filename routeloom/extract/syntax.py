"""Lines of code as tokens, and the calls they make.

Readers of routes, outbound calls and symbols ask this module what stands on a line: they never search its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

_TOKEN = re.compile(r"""(?P<name>[A-Za-z_]\w*)|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`)|(?P<mark>=>|[^\w\s])|(?P<other>\w+)""")


class Token(NamedTuple):
    """``kind``: name, text (a string literal), mark (a sign; an arrow is one) or other. ``start``, ``end``: where it stands."""

    kind: str
    value: str
    start: int
    end: int

    @property
    def literal(self) -> str:
        """What a string literal says, as written."""
        return self.value[1:-1]


#: Lines whose tokens are remembered, and how long such a line may be: a few MB in a worker.
REMEMBERED, SHORT = 2_048, 200


def _read(code: str) -> list[Token]:
    new = tuple.__new__  # as Token(…), without a call in Python for each token
    return [new(Token, (m.lastgroup, m[0], *m.span())) for m in _TOKEN.finditer(code)]


_remembered = lru_cache(REMEMBERED)(_read)


def tokens(code: str) -> list[Token]:
    """White space and what cannot be read is left out; an open quote is a mark. Not to be changed: a reader asks for a line several times, and is given the same list."""
    return _remembered(code) if len(code) <= SHORT else _read(code)


def says(found: Sequence[Token], *values: str) -> bool:
    """Whether the tokens begin with these values."""
    if len(found) < len(values):
        return False
    for t, v in zip(found, values, strict=False):
        if t.value != v:
            return False
    return True


def is_name(found: Sequence[Token], at: int) -> bool:
    return at < len(found) and found[at].kind == "name"


def dotted(found: Sequence[Token]) -> str | None:
    """The name that the tokens spell, parts and dots; None if they spell none."""
    good = len(found) % 2 == 1 and all(t.kind == "name" if i % 2 == 0 else t.value == "." for i, t in enumerate(found))
    return "".join(t.value for t in found) if good else None


def until(found: Sequence[Token], value: str) -> list[Token] | None:
    """The tokens before the first of a value; None if there is none."""
    for i, t in enumerate(found):
        if t.value == value:
            return list(found[:i])
    return None


def pieces(found: Sequence[Token]) -> list[list[Token]]:
    """The tokens between commas, whatever the depth."""
    out: list[list[Token]] = [[]]
    for t in found:
        if t.value == ",":
            out.append([])
        else:
            out[-1].append(t)
    return out


class Call(NamedTuple):
    """``receiver``: the dotted name before the last dot, or empty; ``after_dot``: whether a dot stands before the name;
    ``decorated``: whether an at-sign stands before all of it; ``inside``: the tokens from behind the opening parenthesis to the end of the line;
    ``args``: the tokens of each argument as far as the line has them; ``rest``: the tokens behind the call, None if it does not close."""

    receiver: str
    name: str
    after_dot: bool
    decorated: bool
    first: int
    inside: list[Token]
    args: list[list[Token]]
    rest: list[Token] | None

    def path(self, quotes: str = "'\"") -> str | None:
        """The literal that the first argument begins with."""
        head = self.inside[0] if self.inside else None
        return head.literal if head and head.kind == "text" and head.value[0] in quotes and head.literal else None


def _arguments(found: Sequence[Token]) -> tuple[list[list[Token]], list[Token] | None]:
    args: list[list[Token]] = [[]]
    depth = 0
    for i, t in enumerate(found):
        if t.kind == "mark" and t.value in ")]}":
            if not depth:
                return args if args != [[]] else [], list(found[i + 1 :])
            depth -= 1
        elif t.kind == "mark" and t.value in "([{":
            depth += 1
        elif t.value == "," and not depth:
            args.append([])
            continue
        args[-1].append(t)
    return args, None


def calls(found: Sequence[Token]) -> Iterator[Call]:
    """The calls of a line, by where they open, calls within calls included."""
    for i, t in enumerate(found):
        if t.value != "(" or not i or found[i - 1].kind != "name":
            continue
        first = i - 1
        while first >= 2 and found[first - 1].value == "." and found[first - 2].kind == "name":
            first -= 2
        inside = list(found[i + 1 :])
        args, rest = _arguments(inside)
        yield Call(
            "".join(x.value for x in found[first : max(first, i - 2)]), found[i - 1].value, i >= 2 and found[i - 2].value == ".", first > 0 and found[first - 1].value == "@",
            first, inside, args, rest,
        )


def spelled(code: str, found: Sequence[Token]) -> str:
    """The code from the first to the last of its tokens."""
    return code[found[0].start : found[-1].end] if found else ""
