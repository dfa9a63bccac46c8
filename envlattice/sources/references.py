"""Variables that texts refer to with a dollar sign, found in time linear in the text."""

from __future__ import annotations

import re

#: Characters of a default or message at most, and with it a reference in braces: ``${NAME}`` or ``${NAME<operator>...}``.
BODY = 4096
BRACED = rf"\$\{{(?P<braced>[A-Za-z_][A-Za-z0-9_]*)(?:\}}|(?::[-?+:]|[-?+:])[^}}]{{0,{BODY}}}+\}})"
_BRACED = re.compile(BRACED)
#: What decides where a reference of compose files starts and ends. Pairs that open none come first.
_TOKEN = re.compile(
    r"\$[$(]|\$\{(?P<name>[A-Za-z_][A-Za-z0-9_]*)(?P<required>:?\?)?|(?<![A-Za-z0-9_])\$(?P<bare>[A-Za-z_][A-Za-z0-9_]*)|(?P<brace>[{}])"
)


def braced(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of every ``${NAME}`` and ``${NAME<operator>...}`` with a bounded body, in order."""
    return [(*m.span(), m["braced"]) for m in _BRACED.finditer(text)]


def interpolations(text: str) -> list[tuple[int, str, bool]]:
    """(offset of the dollar, name, required) of ``$A``, ``${A}``, ``${A:-d}`` and ``${A:?e}``; bodies may nest.

    ``$$``, ``$(`` and ``${{`` are passed over, as is a bare dollar behind a name. A brace that closes a reference makes what
    was found since it opened part of its body; one that never closes is none, and what follows it counts.
    """
    out: list[tuple[int, str, bool]] = []
    opened: list[tuple[int, re.Match]] = []  # (how many were found before, the token) of every brace still open
    for m in _TOKEN.finditer(text):
        if m["bare"]:
            out.append((m.start(), m["bare"], False))
        elif m["name"] or m["brace"] == "{":
            opened.append((len(out), m))
        elif m["brace"] and opened:
            before, opener = opened.pop()
            if opener["name"]:
                out[before:] = [(opener.start(), opener["name"], opener["required"] is not None)]
    return out
