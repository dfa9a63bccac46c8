"""The block-style YAML that compose and CI files are written in, as a tree of lines by indentation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from envlattice.sources.positions import Columns

_QUOTED = r"""(?:^|(?<=[ \t=:,\[{(]))(?:"(?:\\.|[^"\\])*(?:"|\\?$)|'(?:''|[^'])*(?:'|$))"""
_COMMENT = re.compile(rf"{_QUOTED}|(?P<mark>(?:^|(?<=[ \t]))#)", re.S)
_COLON = re.compile(rf"{_QUOTED}|(?P<mark>:(?=[ \t]|$))", re.S)
DEPTH = 64


def unquote(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] in "\"'" and text[0] == text[-1] else text


def uncommented(text: str) -> str:
    for m in _COMMENT.finditer(text):
        if m["mark"]:
            return text[: m.start()]
    return text


def colon(text: str) -> int:
    """Where a key ends: the first colon outside quotes with a blank or the end behind it, or -1."""
    return next((m.start() for m in _COLON.finditer(text) if m["mark"]), -1)


@dataclass
class Line:
    """A line with content. Offsets are in ``text``, the line without blanks at its end."""

    number: int
    indent: int
    text: str
    content: str
    start: int
    dash: int = 0
    key: str | None = None
    key_at: int = 0
    value: str = ""
    value_at: int = 0
    mapped: bool = False
    children: list[Line] = field(default_factory=list)

    @cached_property
    def columns(self) -> Columns:
        return Columns(self.text)

    @property
    def comment(self) -> bool:
        return self.content.startswith("#")


def lines(text: str) -> list[Line]:
    """The lines that are not blank; a tab in front makes an indent of -1, below all others."""
    out = []
    for number, raw in enumerate(re.split(r"\r\n|\n|\r", text.removeprefix("﻿")), 1):
        raw = raw.rstrip(" \t")
        body = raw.lstrip(" \t")
        start = len(raw) - len(body)
        content = body if body.startswith("#") else uncommented(raw).strip()
        if not content or content == "---" and start == 0:
            continue
        line = Line(number, -1 if "\t" in raw[:start] else start, raw, content, start)
        if not line.comment:
            _entry(line)
        out.append(line)
    return out


def _entry(line: Line) -> None:
    """Splits a line's content into dash, key and value."""
    dash = re.match(r"-(?:[ \t]+|$)", line.content)
    line.dash = dash.end() if dash else 0
    rest = line.content[line.dash :]
    at = colon(rest)
    raw_key = rest if at < 0 else rest[:at]
    lead = len(raw_key) - len(raw_key.lstrip())
    line.key, line.key_at = unquote(raw_key), line.start + line.dash + lead
    line.mapped = at >= 0
    if at >= 0:
        raw = rest[at + 1 :]
        line.value = raw.strip()
        line.value_at = line.start + line.dash + at + 1 + len(raw) - len(raw.lstrip())


def tree(found: list[Line]) -> list[Line]:
    """The top lines, with all others as children of the nearest line above that is indented less."""
    top: list[Line] = []
    stack: list[Line] = []
    for line in found:
        while stack and stack[-1].indent >= line.indent:
            stack.pop()
        (stack[-1].children if stack else top).append(line)
        stack.append(line)
    return top
