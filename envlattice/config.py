"""Configuration: defaults, files and overrides. Mistakes in a file are warnings, never errors."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, replace

from envlattice.functions import credentials, lists
from envlattice.operators.catalogue import IDS, SEVERITIES

FILE_NAMES = [".envlatticerc.json", "envlattice.config.json"]
KINDS = ["dev", "test", "production", "local", "example", "template", "unknown"]


@dataclass(frozen=True)
class Config:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    env_files: tuple[str, ...] = ()
    example_files: tuple[str, ...] = tuple(lists.EXAMPLE_FILES)
    ignore_rules: frozenset[str] = frozenset()
    ignore_variables: tuple[str, ...] = ()
    ignore_fingerprints: frozenset[str] = frozenset()
    severities: dict[str, str] = field(default_factory=dict)
    weak_values: tuple[str, ...] = tuple(lists.WEAK_VALUES)
    hostile_names: tuple[str, ...] = tuple(lists.HOSTILE_NAMES)
    reserved_names: tuple[str, ...] = tuple(lists.RESERVED_NAMES)
    secret_patterns: tuple[tuple[str, str, str], ...] = tuple(credentials.PATTERNS)
    secret_name_pattern: str = lists.SECRET_NAME
    max_file_size_bytes: int = 64 * 1024
    #: Reserved, as are ci_environment_kinds and code_frame_lines: read and kept, without effect.
    max_line_length: int = 2000
    ci_environment_kinds: dict[str, str] = field(default_factory=lambda: dict(lists.CI_ENVIRONMENT_KINDS))
    fail_on: str = "error"
    code_frame_lines: int = 2
    follow_symlinks: bool = False
    require_example_file: bool = True
    source: str | None = None
    warnings: tuple[str, ...] = ()


def strip_comments(text: str) -> str:
    """JSON without ``//`` and ``/* */`` comments and without commas before a closing bracket; strings stay as they are."""
    string = r'"(?:[^"\\]|\\.)*"?'
    plain = re.sub(rf"({string})|//[^\n]*|/\*.*?(?:\*/|\Z)", lambda m: m[1] or " ", text, flags=re.S)
    return re.sub(rf"({string})|,(?=\s*[}}\]])", lambda m: m[1] or "", plain, flags=re.S)


def discover(folder: str) -> str | None:
    """The nearest configuration file in a folder or above it."""
    folder = os.path.abspath(folder)
    while True:
        for name in FILE_NAMES:
            if os.path.isfile(path := os.path.join(folder, name)):
                return path
        if (above := os.path.dirname(folder)) == folder:
            return None
        folder = above


class _Reader:
    """Takes values of the right kind out of raw JSON and notes the others."""

    def __init__(self, raw: dict, where: str):
        self.raw, self.where, self.notes = raw, where, []

    def note(self, text: str) -> None:
        self.notes.append(f"{self.where}: {text}")

    def of(self, key: str, good, what: str):
        value = self.raw.get(key)
        if value is None:
            return None
        if good(value):
            return value
        self.note(f'"{key}" must be {what}')
        return None

    def strings(self, key: str) -> list[str] | None:
        return self.of(key, lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v), "a list of strings")

    def number(self, key: str) -> int | None:
        good = lambda v: isinstance(v, int | float) and not isinstance(v, bool) and v > 0
        found = self.of(key, good, "a number above zero")
        return None if found is None else int(found) if key != "maxFileSizeKb" else found

    def flag(self, key: str) -> bool | None:
        return self.of(key, lambda v: isinstance(v, bool), "true or false")


KEYS = (
    "$schema include exclude envFiles exampleFiles ignoreRules ignoreVariables ignoreFingerprints severities weakValues "
    "hostileNames reservedNames secretPatterns secretNamePattern maxFileSizeKb maxLineLength ciEnvironmentKinds failOn "
    "codeFrameLines followSymlinks requireExampleFile"
).split()


def _patterns(reader: _Reader) -> list[tuple[str, str, str]]:
    """Own credential shapes: one with a known id replaces it, others are added; each must match its own test."""
    out = {p[0]: p for p in credentials.PATTERNS}
    for entry in reader.of("secretPatterns", lambda v: isinstance(v, list), "a list") or []:
        parts = [entry.get(k) for k in ("id", "name", "pattern")] if isinstance(entry, dict) else [None]
        if not all(isinstance(p, str) and p for p in parts):
            reader.note("a secret pattern needs id, name and pattern")
            continue
        try:
            found = re.compile(parts[2])
        except re.error as e:
            reader.note(f'secret pattern "{parts[0]}" is not a pattern: {e}')
            continue
        if isinstance(test := entry.get("test"), str) and not found.search(test):
            reader.note(f'secret pattern "{parts[0]}" does not match its own test')
            continue
        out[parts[0]] = tuple(parts)
    return list(out.values())


def resolve(raw: dict, where: str = "config", base: Config | None = None) -> Config:
    """Raw JSON over a base. Lists of names are added to the base's, other lists and values replace them."""
    base, r = base or Config(), _Reader(raw, where)
    for key in raw:
        if key not in KEYS:
            r.note(f'unknown key "{key}"')
    rules = []
    for rule in r.strings("ignoreRules") or []:
        rules.append(rule) if rule in IDS else r.note(f'unknown rule "{rule}"')
    severities = dict(base.severities)
    for rule, severity in (r.of("severities", lambda v: isinstance(v, dict), "an object") or {}).items():
        if rule in IDS and severity in SEVERITIES:
            severities[rule] = severity
        else:
            r.note(f'"{rule}": "{severity}" is not a rule and its severity')
    kinds = dict(base.ci_environment_kinds)
    for name, kind in (r.of("ciEnvironmentKinds", lambda v: isinstance(v, dict), "an object") or {}).items():
        if kind in KINDS:
            kinds[name] = kind
        else:
            r.note(f'unknown kind "{kind}"')
    name_pattern = r.of("secretNamePattern", lambda v: isinstance(v, str) and bool(v), "a pattern")
    if name_pattern is not None:
        try:
            re.compile(name_pattern)
        except re.error as e:
            r.note(f"secretNamePattern is not a pattern: {e}")
            name_pattern = None
    added = lambda key, have: (*have, *(v for v in dict.fromkeys(r.strings(key) or []) if v not in have))
    kept = lambda new, old: old if new is None else new
    kb = r.number("maxFileSizeKb")
    return replace(
        base,
        include=added("include", base.include),
        exclude=added("exclude", base.exclude),
        env_files=added("envFiles", base.env_files),
        example_files=added("exampleFiles", base.example_files),
        ignore_rules=base.ignore_rules | set(rules),
        ignore_variables=added("ignoreVariables", base.ignore_variables),
        ignore_fingerprints=base.ignore_fingerprints | {v.lower() for v in r.strings("ignoreFingerprints") or []},
        severities=severities,
        weak_values=tuple(dict.fromkeys((*base.weak_values, *(v.lower() for v in r.strings("weakValues") or [])))),
        hostile_names=added("hostileNames", base.hostile_names),
        reserved_names=added("reservedNames", base.reserved_names),
        secret_patterns=tuple(_patterns(r)) if "secretPatterns" in raw else base.secret_patterns,
        secret_name_pattern=name_pattern or base.secret_name_pattern,
        max_file_size_bytes=base.max_file_size_bytes if kb is None else int(kb * 1024),
        max_line_length=kept(r.number("maxLineLength"), base.max_line_length),
        ci_environment_kinds=kinds,
        fail_on=r.of("failOn", lambda v: v in SEVERITIES, "a severity") or base.fail_on,
        code_frame_lines=kept(r.number("codeFrameLines"), base.code_frame_lines),
        follow_symlinks=kept(r.flag("followSymlinks"), base.follow_symlinks),
        require_example_file=kept(r.flag("requireExampleFile"), base.require_example_file),
        warnings=(*base.warnings, *r.notes),
    )


def load(root: str, path: str | None = None, overrides: dict | None = None) -> Config:
    """The configuration for a project: a given or discovered file, with overrides on top."""
    path = path or discover(root)
    config = Config()
    if path is not None:
        try:
            with open(path, encoding="utf-8") as f:
                raw = json.loads(strip_comments(f.read()))
            if not isinstance(raw, dict):
                raise ValueError("not an object")
            config = replace(resolve(raw, path), source=os.path.abspath(path))
        except (OSError, ValueError) as e:
            config = replace(config, warnings=(f"{path}: cannot be read: {e}",))
    return resolve(overrides, "overrides", config) if overrides else config
