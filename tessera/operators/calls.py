"""Call expressions of source text: a token scan that knows strings, comments and
balanced brackets, shared by all brace, indent and line languages.

A call is a name, what it is called on, whether a marker (``@``) makes it an
annotation or decorator, and its arguments as spans of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_LINE_COMMENT = {"python": "#", "ruby": "#"}
_OPENING = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Token:
    kind: str  # name, string, mark
    text: str
    start: int
    end: int

    @property
    def value(self) -> str:
        """Content of a string."""
        return self.text.lstrip("rRbBfFuU")[1:-1]


@dataclass
class Call:
    name: str
    receiver: str
    marked: bool
    start: int
    end: int
    after: int  # index of the first token behind the call
    args: list[list[Token]] = field(default_factory=list)

    def string(self, at: int) -> str | None:
        """Content of the string with which an argument begins, if it is not empty."""
        if at < len(self.args) and self.args[at][0].kind == "string":
            return self.args[at][0].value or None
        return None

    def first_string(self) -> str:
        return next((t.value for arg in self.args for t in arg if t.kind == "string"), "")


def scan(text: str, language: str) -> list[Token]:
    comment = re.escape(_LINE_COMMENT.get(language, "//"))
    block = "" if language in _LINE_COMMENT else r"|/\*.*?\*/"
    prefix = r"(?:\b[rRbBfFuU]{1,2})?" if language == "python" else ""
    quoted = "|".join(rf"{prefix}{q}(?:\\.|[^{q}\\\n])*{q}" for q in ("'", '"')) + r"|`(?:\\.|[^`\\])*`"
    pattern = re.compile(rf"(?P<comment>{comment}[^\n]*{block})|(?P<string>{quoted})|(?P<name>[\w$]+)|(?P<mark>=>|\S)", re.S)
    return [Token(m.lastgroup, m[0], m.start(), m.end()) for m in pattern.finditer(text) if m.lastgroup != "comment"]


def closing(tokens: list[Token]) -> dict[int, int]:
    """Index of the bracket that closes each opening one."""
    open_at, closes = [], {}
    for i, t in enumerate(tokens):
        if t.kind != "mark":
            continue
        if t.text in _OPENING:
            open_at.append(i)
        elif open_at and t.text == _OPENING[tokens[open_at[-1]].text]:
            closes[open_at.pop()] = i
    return closes


def _arguments(tokens: list[Token], a: int, b: int, closes: dict[int, int]) -> list[list[Token]]:
    args, arg, i = [], [], a
    while i < b:
        if tokens[i].text == "," and tokens[i].kind == "mark":
            args.append(arg)
            arg = []
            i += 1
            continue
        last = min(closes.get(i, i), b - 1)
        arg += tokens[i : last + 1]
        i = last + 1
    return [x for x in [*args, arg] if x]


def calls(tokens: list[Token]) -> Iterator[Call]:
    """Calls in source order, and annotations that have no arguments."""
    closes = closing(tokens)
    for i, t in enumerate(tokens):
        if t.kind != "name":
            continue
        first = i
        while first >= 2 and tokens[first - 1].text == "." and tokens[first - 2].kind == "name":
            first -= 2
        receiver = ".".join(x.text for x in tokens[first:i] if x.kind == "name")
        # a receiver that is itself a call, as in a().b()
        chained = not receiver and i > 0 and tokens[i - 1].text == "."
        marked = first > 0 and tokens[first - 1].text == "@"
        begin = tokens[first - marked].start
        if i + 1 < len(tokens) and tokens[i + 1].text == "(" and i + 1 in closes:
            end = closes[i + 1]
            yield Call(t.text, receiver or ("()" if chained else ""), marked, begin, tokens[end].end, end + 1, _arguments(tokens, i + 2, end, closes))
        elif marked and not (i + 1 < len(tokens) and tokens[i + 1].text == "."):
            yield Call(t.text, receiver, True, begin, t.end, i + 1)
