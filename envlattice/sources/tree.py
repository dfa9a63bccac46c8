"""A project's files as a Spark data source; Spark's own file sources hide names that start with a dot."""

from __future__ import annotations

import os
import subprocess
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from envlattice.config import Config
from envlattice.functions import globs
from envlattice.sources import ci, compose, dockerfile
from envlattice.sources.ignore import Ignore, read_patterns

# Folders, wrappers and extensions that are never read, and the languages of extensions.
SKIPPED_FOLDERS = set(
    ".git .hg .svn node_modules dist build out coverage .next .nuxt .svelte-kit .turbo .cache .venv venv vendor target bin "
    "obj .gradle .idea .vscode .pytest_cache __pycache__ .terraform .tox".split()
)
WRAPPERS = set(
    "gradlew gradlew.bat mvnw mvnw.cmd configure config.guess config.sub ltmain.sh libtool install-sh missing depcomp "
    "test-driver compile ar-lib ylwrap cygwin".split()
)
NOISY = set(
    ".png .jpg .jpeg .gif .ico .pdf .zip .gz .tar .woff .woff2 .ttf .eot .mp4 .mp3 .wasm .so .dll .exe .class .jar .pyc".split()
)
LANGUAGES = {
    "typescript": ".ts .tsx .mts .cts", "javascript": ".js .jsx .mjs .cjs", "python": ".py .pyi", "go": ".go", "rust": ".rs",
    "java": ".java", "kotlin": ".kt .kts", "csharp": ".cs", "ruby": ".rb .erb .rake", "php": ".php", "perl": ".pl .pm .t",
    "shell": ".sh .bash .zsh .ksh", "batch": ".bat .cmd", "swift": ".swift", "dart": ".dart", "elixir": ".ex .exs",
}
ENV_GLOBS = [".env", ".env.*", "env", "env.*", "*.env", "*.env.*"]
_BY_EXTENSION = {e: language for language, some in LANGUAGES.items() for e in some.split()}
SNIFF, SAMPLE = 8192, 8000
#: Bytes of files that one task reads.
PART_BYTES = 4 << 20


def base_name(path: str) -> str:
    return path.replace("\\", "/").rpartition("/")[2]


def extension(name: str) -> str:
    dot = name.rfind(".")
    return name[dot:].lower() if dot > 0 else ""


def language_of(path: str) -> str:
    return _BY_EXTENSION.get(extension(base_name(path).lower()), "unknown")


def is_env_file(path: str, more: tuple[str, ...] = ()) -> bool:
    name = base_name(path)
    return language_of(name) == "unknown" and globs.matches(name, [*ENV_GLOBS, *more], True) or bool(
        more and language_of(name) == "unknown" and globs.matches(path, list(more), True)
    )


def class_of(path: str, config: Config) -> str:
    """The one reader that a file goes to."""
    if is_env_file(path, config.env_files):
        return "env"
    if dockerfile.is_dockerfile(path):
        return "dockerfile"
    if compose.is_compose(path):
        return "compose"
    if ci.dialect(path):
        return "ci"
    return "code" if language_of(path) != "unknown" else "other"


def looks_binary(head: bytes) -> bool:
    head = head[:SAMPLE]
    odd = sum(b < 7 or 14 < b < 32 for b in head)
    return 0 in head or bool(head) and odd / len(head) > 0.3


@dataclass
class Walk:
    """Files to read, as (path, absolute path, bytes), and those that are not, as (path, reason)."""

    files: list[tuple[str, str, int]] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)


def _kind(entry: os.DirEntry, follow: bool) -> str:
    try:
        if entry.is_symlink():
            if not follow or not os.path.exists(entry.path):
                return "symlink"
            return "file" if entry.is_file() else "folder"
        return "folder" if entry.is_dir() else "file" if entry.is_file() else "special"
    except OSError:
        return "special"


def walk(root: str, config: Config, ignore: Ignore | None = None) -> Walk:
    """Walks a tree without opening what its name or size rules out. Only folders are asked for in the ignore rules."""
    out, todo, seen = Walk(), [""], {os.path.realpath(root)}
    exclude, include = list(config.exclude), list(config.include)
    fits = lambda path, name, some: bool(some) and (globs.matches(path, some, True) or globs.matches(name, some, True))
    while todo:
        folder = todo.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            out.skipped.append((folder or ".", "unreadable"))
            continue
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            kind = _kind(entry, config.follow_symlinks)
            if kind in ("symlink", "special"):
                out.skipped.append((path, kind))
            elif kind == "folder":
                if entry.name in SKIPPED_FOLDERS:
                    continue
                real = os.path.realpath(entry.path)
                if fits(path, entry.name, exclude):
                    out.skipped.append((path, "exclude"))
                elif ignore and ignore.ignored(path, True):
                    out.skipped.append((path, "gitignore"))
                elif config.follow_symlinks and real in seen:
                    out.skipped.append((path, "symlink"))
                else:
                    seen.add(real)
                    todo.append(path)
            elif not fits(path, entry.name, exclude):
                if extension(entry.name) in NOISY:
                    out.skipped.append((path, "extension"))
                elif entry.name.lower() in WRAPPERS:
                    out.skipped.append((path, "generated"))
                elif not include or fits(path, entry.name, include):
                    _sized(out, path, entry, config)
    out.files.sort()
    out.skipped.sort()
    return out


def _sized(out: Walk, path: str, entry: os.DirEntry, config: Config) -> None:
    try:
        size = entry.stat().st_size
        if size > config.max_file_size_bytes:
            out.skipped.append((path, "too-large"))
            return
        with open(entry.path, "rb") as f:
            if looks_binary(f.read(SNIFF)):
                out.skipped.append((path, "binary"))
                return
    except OSError:
        out.skipped.append((path, "unreadable"))
        return
    out.files.append((path, entry.path, size))


def tracked_files(root: str) -> set[str] | None:
    """Paths that git tracks, or None where there is no repository; an empty set is not the same."""
    try:
        done = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, timeout=15, check=False)
    except (OSError, subprocess.SubprocessError):
        return None
    return {p for p in done.stdout.decode(errors="replace").split("\0") if p} if done.returncode == 0 else None


@dataclass
class _Part(InputPartition):
    files: list[tuple[str, str, int, str, str]]


class _Reader(DataSourceReader):
    def __init__(self, parts: list[list]):
        self.parts = parts

    def partitions(self) -> list[_Part]:
        return [_Part(p) for p in self.parts] or [_Part([])]

    def read(self, partition: _Part):
        for path, absolute, size, language, kind in partition.files:
            try:
                with open(absolute, "rb") as f:
                    yield path, size, language, kind, f.read().decode("utf-8", "replace")
            except OSError:
                yield path, size, language, kind, None


class TreeSource(DataSource):
    """``contract_tree``: (path, bytes, language, class, text) of the files below ``root``, dotfiles too."""

    @classmethod
    def name(cls) -> str:
        return "contract_tree"

    def schema(self) -> str:
        return "path string, bytes long, language string, class string, text string"

    def reader(self, schema) -> _Reader:
        import json

        listed = json.loads(self.options["files"])
        parts: list[list] = [[]]
        held = 0
        for row in listed:
            if held and held + row[2] > PART_BYTES:
                parts.append([])
                held = 0
            parts[-1].append(tuple(row))
            held += row[2]
        return _Reader([p for p in parts if p])


def read_tree(spark: SparkSession, found: Walk, config: Config) -> DataFrame:
    """The files of a walk with their texts, read on the executors from storage that they share."""
    import json

    spark.dataSource.register(TreeSource)
    rows = [(p, a, n, language_of(p), class_of(p, config)) for p, a, n in found.files]
    return spark.read.format("contract_tree").option("files", json.dumps(rows)).load()


def plan(root: str, config: Config, use_gitignore: bool = True) -> tuple[Walk, Ignore]:
    ignore = Ignore(read_patterns(root, config.exclude) if use_gitignore else [])
    return walk(root, config, ignore), ignore
