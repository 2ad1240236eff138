r"""Literal, regex, wildcard and glob patterns as Column predicates.

There is one regex dialect, for lines and for whole contents: what linear-time
engines and Java share.  Look-around and back-references are refused when the
pattern is compiled; classes such as \w know all of Unicode; ``.`` stops at line
feeds only; ``^`` and ``$`` are the start and the end of a content unless the
pattern itself asks for lines with (?m).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("literal", "regex", "wildcard", "glob")
_BOUNDARY = "[A-Za-z0-9_]"


def quote(text: str) -> str:
    """A Java regex that matches ``text`` itself."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&~#])", r"\\\1", text)


def wildcard_regex(pattern: str, path: bool) -> str:
    """Unanchored; on content ``*`` and ``?`` stay within a line."""
    many, one = (".*", ".") if path else ("[^\\n]*", "[^\\n]")
    return "".join(many if c == "*" else one if c == "?" else quote(c) for c in pattern)


def glob_regex(pattern: str) -> str:
    """Anchored; ``*`` and ``?`` match ``/`` too.  Knows [classes] and {a,b}."""
    out, at, braces = [], 0, 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            if pattern[at : at + 1] == "*":
                at += 1
                if pattern[at : at + 1] == "/" and (at == 2 or pattern[at - 3] == "/"):
                    out.append("(?:.*/)?")
                    at += 1
                    continue
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", at + 1)) > 0:
            body = pattern[at:end]
            negated = body[:1] in ("!", "^")
            out.append("[" + "^" * negated + re.sub(r"([\\\[&])", r"\\\1", body[negated:]) + "]")
            at = end + 1
        elif c == "{":
            braces += 1
            out.append("(?:")
        elif c == "}" and braces:
            braces -= 1
            out.append(")")
        elif c == "," and braces:
            out.append("|")
        elif c == "\\" and at < len(pattern):
            out.append(quote(pattern[at]))
            at += 1
        else:
            out.append(quote(c))
    if braces:
        raise ValueError(f"unclosed brace in glob {pattern!r}")
    return "^(?s:" + "".join(out) + ")$"


def checked_regex(pattern: str) -> str:
    bare = re.sub(r"\\\\", "", pattern)
    if re.search(r"\(\?(?:[=!]|<[=!])", bare) or re.search(r"\\(?:[1-9]|k<)", bare):
        raise ValueError("look-around and back-references are not supported")
    return pattern


def _pieces(pattern: str) -> list[str]:
    """Escapes, classes and other characters of a regex, one by one."""
    return re.findall(r"\\.|\[\^?\]?(?:\\.|\[:\w+:\]|[^\]\\])*\]|\(\?[a-zA-Z-]*[:)]|.", pattern, re.S)


def java_regex(pattern: str) -> str:
    """The checked pattern in Java's syntax: ``$`` is the very end, and names of
    character classes are those of Java."""
    flags = "".join(re.findall(r"\(\?([a-zA-Z]+)", pattern))
    pieces = [r"\z" if p == "$" and "m" not in flags else re.sub(r"\[:(\w+):\]", lambda m: r"\p{" + {"word": "IsWord"}.get(m[1], m[1].title()) + "}", p) for p in _pieces(checked_regex(pattern))]
    wide = any(re.fullmatch(r"\\[wWdDsSbB]", e) for p in pieces for e in re.findall(r"\\.", p))
    return ("(?dU)" if wide else "(?d)") + "".join(pieces)


def spans_lines(pattern: str) -> bool:
    """Whether a regex can match a line break, or is anchored to the content."""
    flags = "".join(re.findall(r"\(\?([a-zA-Z]+)", pattern))
    if "s" in flags or "m" in flags:
        return True
    for piece in _pieces(pattern):
        if piece in ("^", "$", "\n") or re.fullmatch(r"\\[nsWDRvAzZ]", piece) or piece.startswith("[^"):
            return True
        if piece.startswith("[") and (re.search(r"\\[nsWDRv]|\[:space:\]|\n", piece) or any(ord(a) <= 10 <= ord(b) for a, b in re.findall(r"(.)-(.)", piece, re.S))):
            return True
    return False


@dataclass(frozen=True)
class Pattern:
    text: str
    mode: str
    case_sensitive: bool
    path: bool

    @property
    def regex(self) -> str:
        """Java regex of the pattern, with its case flag."""
        body = {
            "literal": lambda: quote(self.text),
            "regex": lambda: java_regex(self.text),
            "wildcard": lambda: wildcard_regex(self.text, self.path),
            "glob": lambda: glob_regex(self.text),
        }[self.mode]()
        return body if self.case_sensitive else "(?iu)" + body

    def matches(self, value: Column) -> Column:
        if self.mode == "literal":
            if self.case_sensitive:
                return F.contains(value, F.lit(self.text))
            return F.contains(F.lower(value), F.lit(self.text.lower()))
        return F.rlike(value, F.lit(self.regex))

    @property
    def spans_lines(self) -> bool:
        return "\n" in self.text if self.mode != "regex" else spans_lines(self.text)

    @property
    def line_literal(self) -> str | None:
        """A literal that every matching content holds, case ignored."""
        return self.text if self.mode == "literal" and self.text.isascii() and self.text else None

    @property
    def prefilter(self) -> str | None:
        """The literal that a trigram index can narrow, if there is one."""
        return self.text if self.mode == "literal" and len(self.text.encode()) >= 3 else None


def compile_pattern(text: str, mode: str = "literal", case_sensitive: bool = False, path: bool = False) -> Pattern:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    pattern = Pattern(text, mode, case_sensitive, path)
    pattern.regex  # noqa: B018  refuses what the dialect lacks
    return pattern


def any_pattern(value: Column, patterns: list[Pattern]) -> Column:
    if not patterns:
        return F.lit(True)
    found = patterns[0].matches(value)
    for p in patterns[1:]:
        found = found | p.matches(value)
    return found


def word_bounded(regex: str) -> str:
    """The regex between identifier boundaries."""
    flags = re.match(r"(?:\(\?[a-zA-Z]+\))*", regex)[0]
    body = regex[len(flags) :]
    return f"{flags}(?<!{_BOUNDARY})(?:{body})(?!{_BOUNDARY})"


# Patterns so broad that a query only gets a sample.
BROAD_PATHS = {"", "*", "**", "**/*", ".*"}
BROAD_REGEXES = {".*", ".+", "^.*$", "^.+$"}
BROAD_LITERALS = {"", "*", "public", "private", "protected", "class", "function", "fn", "let", "const", "var", "if", "for", "while", "return", "import", "export"}


def broad_reason(kind: str, pattern: str, mode: str | None = None) -> str | None:
    text = pattern.strip()
    if kind in ("files", "glob") and text in BROAD_PATHS:
        return "broad_path_pattern"
    if mode == "regex" and text in BROAD_REGEXES:
        return "broad_regex_pattern"
    if kind in ("find", "refs") and (text in BROAD_LITERALS or len(text) <= 1):
        return "broad_literal_pattern"
    return None
