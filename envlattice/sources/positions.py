"""Lines and columns: 1-based, columns in UTF-16 units as editors and the finding formats count."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


class Columns:
    """Columns of offsets of a text, each in logarithmic time."""

    def __init__(self, text: str):
        self.wide = [] if text.isascii() else [m.start() for m in _ASTRAL.finditer(text)]

    def at(self, offset: int) -> int:
        return offset + bisect_left(self.wide, offset) + 1


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return Columns(text).at(len(text)) - 1


class Positions:
    """(line, column) of offsets of a text; lines end at line feeds."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.columns = Columns(text)

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset)
        return line, self.columns.at(offset) - self.columns.at(self.starts[line - 1]) + 1
