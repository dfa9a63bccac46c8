"""Source texts with comments blanked and string places known, by language."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Syntax:
    """How a language writes comments and strings."""

    line: tuple[str, ...] = ()
    block: bool = False
    nested: bool = False
    quotes: str = "'\""
    triple: bool = False
    backtick: str = ""  # plain: a string over lines; template: code inside ${...}
    verbatim: bool = False
    at_line_start: bool = False
    escaped_comments: bool = False
    keyword: str = ""
    escapes: bool = True


_SLASH, _HASH = Syntax(line=("//",), block=True), Syntax(line=("#",), triple=True)


def _with(base: Syntax, **changes) -> Syntax:
    return Syntax(**{**base.__dict__, **changes})


SYNTAX = {
    "javascript": _with(_SLASH, backtick="template"),
    "typescript": _with(_SLASH, backtick="template"),
    "python": _HASH,
    "go": _with(_SLASH, backtick="plain"),
    "rust": _with(_SLASH, nested=True, quotes='"'),
    "java": _SLASH,
    "kotlin": _with(_SLASH, nested=True),
    "csharp": _with(_SLASH, verbatim=True),
    "ruby": _with(_HASH, backtick="plain"),
    "php": _with(_SLASH, line=("//", "#")),
    "perl": _with(_HASH, backtick="plain"),
    "shell": _with(_HASH, triple=False, quotes="'", backtick="plain", at_line_start=True, escaped_comments=True),
    "batch": Syntax(line=("::",), quotes="", at_line_start=True, keyword="rem", escapes=False),
    "swift": _with(_SLASH, nested=True, quotes='"'),
    "dart": _with(_SLASH, nested=True),
    "elixir": _HASH,
}
_LINE_START = r"(?:(?<=[\n\r])|(?<![\s\S]))"


@lru_cache(maxsize=64)
def _scanner(language: str, template: bool) -> re.Pattern:
    """One pattern for all that matters to a language; what it does not match is code."""
    s = SYNTAX[language]
    body = r"(?:\\[\s\S]|[^\\{}])" if s.escapes else "[^{}]"

    def string(quote: str, over_lines: bool, end: str) -> str:
        inner = body.replace("{}", quote + ("" if over_lines else r"\n\r"))
        return f"{quote}{inner}*+(?:{end})"

    parts = []
    comment_end = r"(?:\\[\s\S]|[^\n\\])*+\\?" if s.escaped_comments else r"[^\n]*"
    lead = rf"{_LINE_START}[ \t\f\v]*" if s.at_line_start else ""
    if s.keyword:
        parts.append(rf"{lead}(?P<keyword>(?i:{s.keyword})(?=[ \t]|\Z|\n)[^\n]*)")
    if s.line:
        parts.append(rf"{lead}(?P<comment>(?:{'|'.join(map(re.escape, s.line))}){comment_end})")
    if s.block:
        parts.append(r"(?P<open>/\*)" if s.nested else r"(?P<block>/\*[\s\S]*?(?:\*/|\Z))")
    if s.triple:
        for q in "'\"":
            parts.append(rf"(?P<triple{ord(q)}>{q * 3}(?:\\[\s\S]|(?!{q * 3})[^\\])*+(?:{q * 3}|\\?\Z))")
    if s.verbatim:
        parts.append(rf'(?P<verbatim>@{string(chr(34), True, chr(34) + "|" + chr(92) * 2 + "?" + chr(92) + "Z")})')
    if s.backtick == "plain":
        parts.append(f"(?P<backtick>{string('`', True, '`|' + chr(92) * 2 + '?' + chr(92) + 'Z')})")
    elif s.backtick:
        parts.append("(?P<template>`)")
    for q in s.quotes:
        parts.append(f"(?P<quote{ord(q)}>{string(q, False, q + '|(?=[' + chr(92) + 'n' + chr(92) + 'r])|' + chr(92) * 2 + '?' + chr(92) + 'Z')})")
    if template:
        parts.append(r"(?P<brace>[{}])")
    return re.compile("|".join(parts))


_TEMPLATE = re.compile(r"(?:\\[\s\S]|[^\\`$]|\$(?!\{))*+(?P<end>`|\$\{|\\?\Z)")
_NESTED = re.compile(r"/\*|\*/")


class Masked:
    """``code``: the text with comments as blanks, so that offsets hold. ``in_string`` says whether an offset is in one."""

    def __init__(self, text: str, language: str):
        self.starts: list[int] = []
        self.ends: list[int] = []
        blanks: list[tuple[int, int]] = []
        at, depths = 0, []  # of braces in the code of each open template
        while at < len(text):
            m = _scanner(language, bool(depths)).search(text, at)
            if m is None:
                break
            kind = m.lastgroup
            start, at = m.start(kind), m.end()
            if kind in ("comment", "keyword", "block"):
                blanks.append((start, at))
            elif kind == "open":
                at = self._close(text, at)
                blanks.append((start, at))
            elif kind == "brace":
                depths[-1] += 1 if m[kind] == "{" else -1
                if not depths[-1]:
                    depths.pop()
                    at = self._template(text, at, depths)
            elif kind == "template":
                self._mark(start, at)
                at = self._template(text, at, depths)
            else:
                self._mark(start, at)
        pieces, last = [], 0
        for a, b in blanks:
            pieces += [text[last:a], re.sub(r"[^\n]", " ", text[a:b])]
            last = b
        self.code = "".join([*pieces, text[last:]])

    def _mark(self, start: int, end: int) -> None:
        if self.ends and self.ends[-1] == start:
            self.ends[-1] = end
        else:
            self.starts.append(start)
            self.ends.append(end)

    def _template(self, text: str, at: int, depths: list[int]) -> int:
        """A template's letters, up to its end or to code inside."""
        m = _TEMPLATE.match(text, at)
        self._mark(at, m.end())
        if m["end"] == "${":
            depths.append(1)
        return m.end()

    @staticmethod
    def _close(text: str, at: int) -> int:
        depth = 1
        for m in _NESTED.finditer(text, at):
            depth += 1 if m[0] == "/*" else -1
            if not depth:
                return m.end()
        return len(text)

    def in_string(self, offset: int) -> bool:
        i = bisect_right(self.starts, offset) - 1
        return i >= 0 and offset < self.ends[i]
