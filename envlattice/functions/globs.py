"""Globs as regular expressions that Java, Python and RE2 read alike."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"(?P<deep>\*\*/)|(?P<any>\*\*)|(?P<star>\*)|(?P<one>\?)|\{(?P<either>[^}]*)\}|(?P<plain>.)", re.S)
_SPECIAL = re.compile(r"[.*+?^${}()|\[\]\\]")


def quote(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def _part(m: re.Match) -> str:
    kind = m.lastgroup
    if kind == "either":
        return f"(?:{'|'.join(map(quote, m['either'].split(',')))})"
    return {"deep": "(?:.*/)?", "any": ".*", "star": "[^/]*", "one": "[^/]"}.get(kind) or quote(m[0])


def glob_regex(glob: str) -> str:
    """``*`` and ``?`` stay within a folder, ``**`` does not, ``**/`` may be nothing, and ``{a,b}`` is either."""
    return f"^{''.join(map(_part, _TOKEN.finditer(glob)))}\\z"


def any_glob(globs: list[str], ignore_case: bool = False) -> str | None:
    """One pattern for several globs; None for none."""
    return (("(?i)" if ignore_case else "") + "|".join(map(glob_regex, globs))) if globs else None


def matches(value: str, globs: list[str], ignore_case: bool = False) -> bool:
    found = any_glob(globs, ignore_case)
    return bool(found and re.search(found.replace("\\z", "\\Z"), value))
