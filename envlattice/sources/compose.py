"""Compose files: environments, env files, build arguments and interpolations."""

from __future__ import annotations

import re

from envlattice.sources import yamlish
from envlattice.sources.references import interpolations
from envlattice.sources.yamlish import Line, unquote

_FILE = re.compile(r"(?:docker-)?compose(?:[.-][\w.-]+)?\.ya?ml", re.I | re.A)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def is_compose(path: str) -> bool:
    return _FILE.fullmatch(path.replace("\\", "/").rpartition("/")[2]) is not None


class _Scan:
    def __init__(self, path: str):
        self.path, self.out = path, []

    def add(self, name: str, line: Line, offset: int, kind: str, required: bool, to_file: bool = False, used: bool = False) -> None:
        self.out.append({
            "name": name, "file": self.path, "line": line.number, "column": line.columns.at(offset), "kind": kind,
            "required": required, "refers_to_file": to_file, "interpolation": used,
        })

    def assignments(self, children: list[Line], kind: str) -> None:
        """``NAME: value`` is required if the value is empty, ``- NAME=value`` if it has no sign."""
        for line in children:
            if line.comment:
                continue
            if line.dash:
                body = line.content[line.dash :]
                text = unquote(body)
                name, sign, _ = text.partition("=")
                name = unquote(name)
                if _NAME.fullmatch(name):
                    self.add(name, line, line.start + line.dash, kind, not sign)
            elif _NAME.fullmatch(line.key):
                self.add(line.key, line, line.key_at, kind, not unquote(line.value))

    def files(self, text: str, line: Line, offset: int) -> None:
        """One file or a list with commas."""
        for part in text.split(","):
            if name := unquote(part):
                self.add(name, line, offset + len(part) - len(part.lstrip()), "compose-env-file", True, to_file=True)
            offset += len(part) + 1

    def env_file(self, line: Line) -> None:
        if unquote(line.value):
            self.files(unquote(line.value), line, line.value_at)
            return
        for child in line.children:
            if child.comment or not child.dash:
                continue
            if not child.mapped:
                self.files(unquote(child.content[child.dash :]), child, child.start + child.dash)
            elif child.key == "path" and unquote(child.value):
                self.files(unquote(child.value), child, child.value_at)

    def environment(self, line: Line) -> None:
        if not unquote(line.value):
            self.assignments(line.children, "compose-environment")

    def build(self, line: Line) -> None:
        for child in line.children if not unquote(line.value) else []:
            if not child.comment and child.key == "args" and not unquote(child.value):
                self.assignments(_all(child), "compose-build-arg")

    def service(self, line: Line) -> None:
        for child in line.children:
            if child.comment or child.dash or child.key.startswith("x-"):
                continue
            if child.key in ("environment", "env_file", "build"):
                getattr(self, child.key)(child)


def _all(line: Line) -> list[Line]:
    return [x for child in line.children for x in (child, *_all(child))]


def scan(path: str, text: str) -> list[dict]:
    """Rows of the infra relation, in order of place, name and kind."""
    found = yamlish.lines(text)
    yamlish.tree(found)
    run = _Scan(path)
    plain = [x for x in found if not x.comment and not x.dash and x.indent == 0]
    services = next((x for x in plain if x.mapped and x.key == "services"), None)
    seen = set()
    for line in services.children if services else []:
        if line.comment or line.dash or unquote(line.value) or not line.key or line.key.startswith("x-") or line.key in seen:
            continue
        seen.add(line.key)
        run.service(line)
    for key, read in (("env_file", run.env_file), ("env", run.environment)):
        if line := next((x for x in plain if x.key == key), None):
            read(line)
    for line in found:
        if not line.comment:
            for offset, name, required in interpolations(line.content):
                run.add(name, line, line.start + offset, "compose-interpolation", required, used=True)
    return sorted(run.out, key=lambda r: (r["line"], r["column"], r["name"], r["kind"]))
