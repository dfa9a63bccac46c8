"""A project tree to relations: every file goes to one reader, in Arrow batches on the executors."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envlattice import schemas
from envlattice.config import Config
from envlattice.operators.relations import Manifest, Relations, missing_files
from envlattice.sources import accessors, ci, compose, dockerfile, dotenv, markers, tree
from envlattice.sources.ignore import PRUNED
from envlattice.sources.positions import Positions

MANIFESTS, MANIFEST_DEPTH = 200, 4
_DOTENV_PATHS = [
    re.compile(rf"{call}\s*\(\s*\{{[^}}]*?\bpath\s*:\s*['\"`](?P<path>[^'\"`\n]+)['\"`]", re.I)
    for call in (r"dotenv\s*\.\s*config", r"new\s+Dotenv")
]


def dotenv_paths(path: str, text: str) -> list[dict]:
    """Env files that scripts name when they load them."""
    place, out = Positions(text), []
    for pattern in _DOTENV_PATHS:
        for m in pattern.finditer(text):
            line, column = place.at(m.start())
            out.append({
                "name": m["path"], "file": path, "line": line, "column": column, "kind": "dotenv-path", "required": True,
                "refers_to_file": True, "interpolation": False,
            })
    return out


#: Rows that a reader's task gives out at once.
ROWS = 20_000


def _mapped(files: DataFrame, schema, rows: Callable[..., list], *more: str, pieces: bool = False) -> DataFrame:
    """A relation from texts: ``rows`` gives tuples or dictionaries; a file that a reader fails on gives none.

    A task holds one file's text and rows at a time. ``more`` names further columns that ``rows`` gets. With ``pieces`` a text may
    come in several rows, one behind the other, and a column ``last`` is true in its last row only.
    """
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)

        def given(found: list) -> pa.RecordBatch:
            found = [tuple(r[n] for n in names) if isinstance(r, dict) else r for r in found]
            columns = list(zip(*found, strict=True)) if found else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

        found: list = []
        parts: list[str] = []
        for batch in batches:
            for at in range(batch.num_rows):
                if pieces:
                    parts.append(batch.column(3)[at].as_py() or "")
                    if not batch.column(4)[at].as_py():
                        continue
                path, language, kind, text, *others = (c[at].as_py() for c in batch.columns)
                if pieces:
                    _, *others = others
                    text = "".join(parts)
                    parts.clear()
                try:
                    found += rows(path, language, kind, text or "", *others)
                except Exception:  # noqa: BLE001, S112  one odd file must not end the scan
                    continue
                if len(found) >= ROWS:
                    for i in range(0, len(found), ROWS):
                        yield given(found[i : i + ROWS])
                    found = []
        yield given(found)

    last = ["last"] if pieces else []
    return files.select("path", "language", "class", "text", *last, *more).mapInArrow(run, schema)


def _infra(path: str, language: str, kind: str, text: str) -> list[dict]:
    if kind == "code":
        return dotenv_paths(path, text) if language in ("javascript", "typescript") else []
    return {"dockerfile": dockerfile.scan, "compose": compose.scan, "ci": ci.scan}[kind](path, text)


def _names(value) -> list[str]:
    return sorted(value) if isinstance(value, dict) else []


def _load(path: str) -> dict | None:
    try:
        with open(path, encoding="utf-8-sig") as f:
            value = json.load(f)
        return value if isinstance(value, dict) else None
    except (OSError, ValueError):
        return None


def read_manifest(root: str, left_out: list[tuple[str, str]] | None = None) -> Manifest | None:
    """The project's package manifest with the dependencies of all others, to a bounded depth and number.

    ``left_out`` gets (folder, reason) of the folders where the bounds ended the search.
    """
    left_out = [] if left_out is None else left_out
    own = _load(os.path.join(root, "package.json"))
    if own is None:
        return None
    related, todo, n = set(), [(root, 0)], 0
    while todo and n < MANIFESTS:
        folder, depth = todo.pop(0)
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            if e.name == "package.json" and (found := _load(e.path)) is not None:
                n += 1
                related.update(_names(found.get("dependencies")), _names(found.get("devDependencies")))
            elif e.name not in PRUNED and e.is_dir(follow_symlinks=False):
                if depth < MANIFEST_DEPTH:
                    todo.append((e.path, depth + 1))
                else:
                    left_out.append((os.path.relpath(e.path, root).replace(os.sep, "/"), "manifests-too-deep"))
    left_out += [(os.path.relpath(folder, root).replace(os.sep, "/"), "manifests-too-many") for folder, _ in todo]
    strings = lambda v: {k: x for k, x in sorted(v.items()) if isinstance(x, str)} if isinstance(v, dict) else {}
    name = own.get("name")
    return Manifest(
        "package.json", name if isinstance(name, str) else None, tuple(_names(own.get("dependencies"))),
        tuple(_names(own.get("devDependencies"))), strings(own.get("scripts")), strings(own.get("engines")), tuple(sorted(related)),
    )


@dataclass(frozen=True)
class Scan:
    """A project's relations, and what the run itself has to say."""

    relations: Relations
    root: str
    files_scanned: int
    bytes_scanned: int
    skipped: list[tuple[str, str]]
    diagnostics: DataFrame
    texts: DataFrame

    def release(self) -> None:
        """Frees what the scan keeps for all rules."""
        for kept in (self.texts, self.relations.decls, self.relations.usages, self.relations.infra, self.relations.env_files):
            kept.unpersist()


def scan(spark: SparkSession, root: str, config: Config | None = None, use_gitignore: bool = True) -> Scan:
    """Reads a project. The walk and git run on the driver; texts are read and parsed on the executors.

    Texts do not go beyond the readers: what is kept are the relations, until ``release``. Files and folders that a bound leaves out,
    wholly or for one reader, are in ``skipped``.
    """
    config = config or Config()
    root = os.path.abspath(root)
    found, ignore = tree.plan(root, config, use_gitignore)
    tracked = tree.tracked_files(root)
    skipped = list(found.skipped)
    if tracked is not None:
        skipped += [(p, "gitignore") for p, _, _ in found.files if p not in tracked and ignore.ignored(p, False)]
    skipped += [(p, "too-large-for-markers") for p, _, n in found.files if n > markers.MAX_BYTES]
    skipped += [(p, "too-large-for-reads") for p, _, n in found.files if n > accessors.MAX_BYTES and tree.class_of(p, config) == "code"]
    files = tree.read_tree(spark, found, config).persist()
    env = files.where("class = 'env'")
    examples = config.example_files

    def parsed(part: str):
        def rows(path: str, language: str, kind: str, text: str) -> list[dict]:
            kind, shared, dev_only = dotenv.classify(path, examples)
            return getattr(dotenv.parse(path, text, kind, shared, dev_only), part)

        return rows

    facts = []
    for path, _, size in found.files:
        if tree.class_of(path, config) == "env":
            kind, shared, dev_only = dotenv.classify(path, examples)
            here = path in tracked if tracked is not None else kind != "local" and not ignore.ignored(path, False)
            facts.append((path, kind, True, shared, dev_only, here, here, size))
    names = "path string, kind string, exists boolean, shared boolean, dev_only boolean, tracked boolean, committed boolean, byte_size long"
    decls = _mapped(env, schemas.DECLS, parsed("decls"))
    issues = _mapped(env, schemas.ISSUE, parsed("issues"))
    by_file = issues.groupBy(F.col("file").alias("path")).agg(
        F.array_sort(F.collect_list(F.struct("line", "column", "kind", "message", "file"))).alias("i")
    )
    ordered = F.transform("i", lambda x: F.struct(x["kind"], x["message"], x["file"], x["line"], x["column"]))
    counts = decls.groupBy(F.col("file").alias("path")).agg(F.count("*").cast("int").alias("n"))
    kind = schemas.ENV_FILES["issues"].dataType
    there = (
        spark.createDataFrame(facts, names).join(by_file, "path", "left").join(counts, "path", "left")
        .withColumn("decl_count", F.coalesce("n", F.lit(0)))
        .withColumn("issues", F.coalesce(ordered.cast(kind), F.array().cast(kind)))
        .select(*schemas.ENV_FILES.fieldNames())
    )
    infra = _mapped(files.where("class in ('dockerfile', 'compose', 'ci', 'code')"), schemas.INFRA, _infra)
    code = files.where((F.col("class") == "code") & (F.col("bytes") <= accessors.MAX_BYTES))
    usages = _mapped(code, schemas.USAGES, lambda path, language, kind, text: accessors.scan(path, text, language))
    env_files = there.unionByName(missing_files(infra, there).select(*schemas.ENV_FILES.fieldNames()))
    suppressions = markers.markers(files.where(F.col("bytes") <= markers.MAX_BYTES).select("path", "text"))
    rel = Relations(decls, usages, infra, env_files, suppressions, read_manifest(root, skipped))
    size = sum(n for _, _, n in found.files)
    return Scan(rel.cached(), root, len(found.files), size, sorted(skipped), _mapped(env, schemas.DIAGNOSTICS, parsed("notes")), files)
