"""CI files of four dialects: what they declare, which secrets they need and what their scripts use."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from envlattice.sources import yamlish
from envlattice.sources.references import braced
from envlattice.sources.yamlish import DEPTH, Line, unquote

# Where each dialect's files are, and the keys of shell scripts.
_DIALECTS = [
    ("github", r"(?:^|/)\.github/workflows/[^/.][^/]*\.ya?ml$"),
    ("github", r"(?:^|/)\.github/actions/(?:[^/]+/)*action\.ya?ml$"),
    ("gitlab", r"^\.gitlab-ci\.yml$|(?:^|/)\.gitlab/ci/[^/.][^/]*\.yml$"),
    ("azure", r"^azure-pipelines\.ya?ml$"),
    ("circleci", r"(?:^|/)\.circleci/config\.yml$"),
]
_COMPOSE_LIKE = re.compile(r"(?:^|[-._])compose(?:[-._]|$)", re.I)
SCRIPT_KEYS = {"script", "before_script", "after_script", "entrypoint", "variables"}


# Contexts of an expression, the kind of what their members name, and which dialects know them.
_CONTEXTS = {"secrets": "ci-secret", "vars": "ci-var", "env": "ci-env-usage", "variables": "ci-env-usage"}
_NAME = r"(?P<name>[A-Za-z_][A-Za-z0-9_]*)"


def _members(*contexts: str) -> str:
    return rf"(?<![\w./-])(?P<context>{'|'.join(contexts)})\.{_NAME}"


GITHUB = re.compile(_members("secrets", "vars", "env"), re.A)
AZURE = re.compile(rf"\$\({_NAME}\)|{_members('variables', 'env').replace('<name>', '<member>')}", re.A)
SHELL = re.compile(rf"(?<![$\\])\${_NAME}")


def dialect(path: str) -> str | None:
    path = path.replace("\\", "/").removeprefix("./")
    found = next((d for d, p in _DIALECTS if re.search(p, path)), None)
    in_workflows = "/workflows/" in path and _COMPOSE_LIKE.search(path.rpartition("/")[2])
    return None if found == "github" and in_workflows else found


@dataclass
class Entry:
    """A key with a value and what stands below it; items of a list stand in the place of their list."""

    line: Line
    key: str | None
    value: str
    children: list[Entry] = field(default_factory=list)


def entries(found: list[Line]) -> list[Entry]:
    """The file's entries, nested no deeper than DEPTH. A list may stand at the indent of its key."""
    top: list[Entry] = []
    stack: list[tuple[int, bool, list[Entry]]] = []  # (indent, of a dash, where children go)
    for line in found:
        if line.comment:
            continue
        while stack and (stack[-1][0] > line.indent or stack[-1][0] == line.indent and (not line.dash or stack[-1][1])):
            stack.pop()
        into = stack[-1][2] if stack else top
        entry = Entry(line, line.key if line.mapped and line.key else None, line.value if line.mapped else line.content[line.dash :])
        if len(stack) <= 2 * DEPTH:
            into.append(entry)
        if line.dash:
            stack.append((line.indent, True, into))
        stack.append((line.indent + line.dash, False, entry.children))
    return top


def open_lines(raw: list[str]) -> list[str]:
    """Those of a text's lines under which what follows it may stand; what they end is told by them as by the whole text.

    From the end: a line closes those before it that are indented more, and as much unless it is an item below their key.
    """
    out: list[str] = []
    low, item = math.inf, False
    for text in reversed(raw):
        body = text.strip(" \t")
        start = len(text) - len(text.lstrip(" \t"))
        indent = -1 if "\t" in text[:start] else start
        if indent > low or not body or body[0] == "#" or body == "---" and not start:
            continue
        dash = body == "-" or body[:2] in ("- ", "-\t")
        if indent < low or item and not dash:
            out.append(text)
            low, item = indent, dash
    return out[::-1]


def walk(found: list[Entry]):
    for entry in found:
        yield entry
        yield from walk(entry.children)


class _Scan:
    def __init__(self, path: str):
        self.path, self.out = path, []

    def add(self, name: str, line: Line, offset: int, kind: str, required: bool, used: bool) -> None:
        self.out.append({
            "name": name, "file": self.path, "line": line.number, "column": line.columns.at(offset), "kind": kind,
            "required": required, "refers_to_file": False, "interpolation": used,
        })

    def declare(self, found: list[Entry]) -> None:
        for e in found:
            if e.key is not None:
                quote = e.line.text[e.line.key_at : e.line.key_at + 1] in ("'", '"')
                self.add(e.key, e.line, e.line.key_at + quote, "ci-env", not unquote(e.value), False)

    def uses(self, line: Line, text: str, offset: int, pattern: re.Pattern) -> None:
        """What one pattern with a branch for each form finds from left to right, so that hits never overlap."""
        for m in pattern.finditer(text):
            found = m.groupdict()
            kind = _CONTEXTS.get(found.get("context"), "ci-env-usage")
            group = "name" if found["name"] else "member"
            self.add(m[group], line, offset + m.start(group), kind, kind == "ci-secret", True)

    def shell(self, entry: Entry, depth: int = 0) -> None:
        """Variables in an entry's value and in all below it."""
        if entry.value:
            at = entry.line.value_at if entry.line.mapped else entry.line.start + entry.line.dash
            for start, _, name in braced(entry.value):
                self.add(name, entry.line, at + start + 2, "ci-env-usage", False, True)
            self.uses(entry.line, entry.value, at, SHELL)
        for child in entry.children if depth < DEPTH else []:
            self.shell(child, depth + 1)


def scan(path: str, text: str, first: int = 1, above: Sequence[str] = ()) -> list[dict]:
    """Rows of the infra relation, in order of place, name and kind.

    ``text`` may be a piece of whole lines from line ``first`` on; ``above`` has the ``open_lines`` of all before it.
    """
    skip = len(above) + 1 if first > 1 else 0
    kind, found = dialect(path), yamlish.lines("\n".join(["", *above, text]) if skip else text)
    top, run = entries(found), _Scan(path)
    pattern = {"github": GITHUB, "azure": AZURE}.get(kind)
    for line in found if pattern else []:
        if not line.comment:
            run.uses(line, line.text, 0, pattern)
    for e in walk(top):
        if kind == "github" and e.key == "env" and not e.value or kind == "azure" and e.key == "variables":
            run.declare(e.children)
        elif kind == "gitlab" and e.key in SCRIPT_KEYS:
            run.shell(e)
        elif kind == "circleci" and e.key == "environment":
            run.declare(e.children)
            run.shell(e)
    for e in top:
        if kind == "gitlab" and e.key == "variables" or kind == "azure" and e.key == "env" and not e.value:
            run.declare(e.children)
    if skip:
        run.out = [r for r in run.out if r["line"] > skip]
        for r in run.out:
            r["line"] += first - 1 - skip
    return sorted(run.out, key=lambda r: (r["line"], r["column"], r["name"], r["kind"]))
