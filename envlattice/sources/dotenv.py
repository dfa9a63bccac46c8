"""Dotenv files: declarations, parse issues and notes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from envlattice.functions import globs
from envlattice.sources.positions import units

LONG_LINE = 2048
_LINE_END = re.compile(r"\r\n|\n|\r")
_HEAD = re.compile(r"[ \t﻿]*(?P<export>export[ \t]+)?(?P<name>[^=]*)(?P<separator>=)?")
_BAD_KEY = re.compile(r"[\s\"'=:]")
_REFERENCE = re.compile(r"\$\{?(?:(?P<name>[A-Z_][A-Za-z0-9_]*))?")
_DOUBLE = re.compile(r'(?P<end>")|\\(?P<hex>x[0-9A-Fa-f]{2})|\\(?P<letter>[nrtfbv\\"\'$0])|(?P<plain>\\|[^"\\]+)')
_COMMENT = re.compile(r"(?:^|(?<=[ \t]))#")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_LETTERS = {"n": "\n", "r": "\r", "t": "\t", "f": "\f", "b": "\b", "v": "\v", "0": "\0"}


@dataclass
class EnvText:
    """What a dotenv file says: rows of the relations, as dictionaries."""

    decls: list[dict] = field(default_factory=list)
    issues: list[dict] = field(default_factory=list)
    notes: list[dict] = field(default_factory=list)


def lines_of(text: str) -> list[str]:
    """Lines without their ends; a last line end starts no further line, and one byte order mark is dropped."""
    out = _LINE_END.split(text.removeprefix("﻿"))
    return out[:-1] if out[-1] == "" else out


def references(raw: str) -> list[str]:
    """Names that a value refers to, once each in order; not behind a backslash or another dollar sign."""
    found, at = {}, 0
    while m := _REFERENCE.search(raw, at):
        at = m.start() + 1
        if m["name"] and raw[m.start() - 1 : m.start()] not in ("\\", "$"):
            found[m["name"]] = None
            at = m.end()
    return list(found)


def _unescape(segment: str) -> tuple[str, int]:
    """A double-quoted part up to its end: (text, offset of the quote or -1)."""
    out = []
    for m in _DOUBLE.finditer(segment):
        if m["end"]:
            return "".join(out), m.start()
        if m["hex"]:
            out.append(chr(int(m["hex"][1:], 16)))
        elif m["letter"]:
            out.append(_LETTERS.get(m["letter"], m["letter"]))
        else:
            out.append(m["plain"])
    return "".join(out), -1


def _quoted(lines: list[str], first: int, offset: int, quote: str) -> tuple[str, str, int, int]:
    """(value, raw, last line, offset behind the closing quote or -1) of a value that may span lines."""
    values, raws = [], []
    for i in range(first, len(lines)):
        segment = lines[i][offset:]
        value, end = (segment.partition("'")[0], segment.find("'")) if quote == "'" else _unescape(segment)
        values.append(value)
        raws.append(segment if end < 0 else segment[:end])
        if end >= 0:
            return "\n".join(values), "\n".join(raws), i, offset + end + 1
        offset = 0
    return "\n".join(values), "\n".join(raws), len(lines) - 1, -1


def _comment(line: str) -> str | None:
    line = line.strip()
    return line[1:].removeprefix(" ").strip() if line.startswith("#") else None


def parse(path: str, text: str, kind: str = "dev", shared: bool = True, dev_only: bool = False) -> EnvText:
    """Reads a file. Lines that are no assignments become issues; everything else is a declaration."""
    out, lines = EnvText(), lines_of(text)
    first_line: dict[str, int] = {}
    above: list[str] = []
    done = -1

    def issue(kind: str, message: str, line: int, column: int) -> None:
        out.issues.append({"kind": kind, "message": message, "file": path, "line": line, "column": column})

    def note(code: str, message: str, line: int, column: int) -> None:
        out.notes.append({"file": path, "line": line, "column": column, "code": code, "severity": "warn", "message": message})

    for i, line in enumerate(lines):
        number = i + 1
        if units(line) > LONG_LINE:
            note("line-too-long", f"line {number} has {units(line)} letters", number, 1)
        if i <= done:
            continue
        if not line.strip():
            above = []
            continue
        if (comment := _comment(line)) is not None:
            above.append(comment)
            continue
        head, comments, above = _HEAD.match(line), above, []
        name, column = head["name"].strip(), units(line[: head.start("name")]) + 1
        if not name or _BAD_KEY.search(name):
            issue("unknown", f"line {number} is no assignment", number, column)
            continue
        decl = {
            "name": name, "file": path, "line": number, "column": column, "value": "", "has_value": False, "quoted": None,
            "exported": bool(head["export"]), "references": [], "duplicate_of_line": first_line.get(name),
            "leading_comments": comments, "inline_comment": None, "unquoted_inline_comment": None,
            "has_trailing_whitespace": line.endswith((" ", "\t")), "kind": kind, "shared": shared, "dev_only": dev_only,
        }
        raw = ""
        if not head["separator"]:
            following = lines[i + 1] if i + 1 < len(lines) else ""
            if following.strip() and _comment(following) is None:
                issue("no-separator", f"line {number} has no = and its value seems to follow", number, column)
                continue
        else:
            rest = line[head.end() :]
            start = head.end() + len(rest) - len(rest.lstrip(" \t"))
            quote = line[start : start + 1]
            if quote in ("'", '"'):
                decl["value"], raw, done, end = _quoted(lines, i, start + 1, quote)
                decl["has_value"], decl["quoted"] = True, quote
                if end < 0:
                    issue("unterminated-quote", f"the quote of line {number} is not closed", number, units(line[:start]) + 1)
                else:
                    tail = lines[done][end:].strip()
                    if tail.startswith("#"):
                        decl["inline_comment"] = tail[1:].strip()
                    elif tail:
                        place = units(lines[done][: end + len(lines[done][end:]) - len(lines[done][end:].lstrip())]) + 1
                        note("trailing-garbage", f"text behind the quote of line {done + 1} is ignored", done + 1, place)
            else:
                region = line[start:]
                cut = _COMMENT.search(region)
                if cut and cut.start() == 0 and start == head.end():
                    cut = _COMMENT.search(region, 1)  # a mark right behind the sign is part of the value
                raw = region[: cut.start()].rstrip() if cut else region.rstrip()
                decl["value"], decl["has_value"] = raw, bool(raw)
                decl["unquoted_inline_comment"] = region[cut.start() :].rstrip() if cut else None
        decl["references"] = references(raw)
        if _CONTROL.search(decl["value"]):
            note("control-characters", f"the value of line {number} has control characters", number, column)
        first_line.setdefault(name, number)
        out.decls.append(decl)
    return out


_SAMPLES = {"example": "example", "sample": "example", "dist": "example", "template": "template"}
_KINDS = [
    ({"test", "testing", "e2e", "ci", "staging", "preview"}, "test"),
    ({"prod", "production", "live"}, "production"),
    ({"dev", "develop", "development", "local"}, "dev"),
]


def classify(path: str, example_files: tuple[str, ...] = ()) -> tuple[str, bool, bool]:
    """(kind, shared, dev_only) of an env file by the words of its name."""
    name = path.lower().rstrip("/").rpartition("/")[2]
    words = set(re.split(r"[.\-_]", re.sub(r"^\.env\.", "", re.sub(r"\.env\Z", ".", name))))
    sample = [w for w in ("example", "sample", "dist", "template") if w in words]
    if sample:
        kind = _SAMPLES[sample[0]]
    elif name.endswith(".local") or name.startswith(".env.local") or ".local." in name:
        kind = "local"
    else:
        kind = next((k for some, k in _KINDS if some & words), None)
        if kind is None:
            listed = any(globs.matches(p, list(example_files), True) for p in (name, path.lower()))
            kind = "example" if listed else "dev"
    return kind, kind not in ("local", "example", "template"), kind in ("local", "test")
