"""A finished run on the driver: findings, summary and variables, ordered by the engine."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import envlattice
from envlattice.config import Config
from envlattice.operators import findings, rollup
from envlattice.sources.project import Scan

NAME = "envlattice"


def dumps(value, pretty: bool = True) -> str:
    """JSON with sorted keys, so that equal results are equal texts."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def plain(row, drop_null: bool = False) -> dict:
    """A Row as nested dictionaries with the keys of the JSON document."""
    out = {}
    for k, v in row.asDict(recursive=True).items():
        if v is not None or not drop_null:
            out[camel(k)] = _value(v)
    return out


def _value(v):
    if isinstance(v, list):
        return [_value(x) for x in v]
    if isinstance(v, dict):
        return {camel(k) if "-" not in k else k: _value(x) for k, x in v.items()}
    return v


@dataclass
class Report:
    """What the sinks print. Raw values are not in it."""

    root: str
    findings: list[dict]
    summary: dict
    files: list[dict]
    variables: list[dict]
    files_scanned: int = 0
    bytes_scanned: int = 0
    skipped: list[tuple[str, str]] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)
    counts: dict = field(default_factory=dict)
    duration_ms: int = 0
    tool: dict = field(default_factory=lambda: {"name": NAME, "version": envlattice.__version__})


def build(scan: Scan, config: Config, redact: bool = True) -> Report:
    """Runs all rules and gathers what the sinks need: findings and summaries, not relations.

    This is for a project whose report a person reads. Findings over tables are given out as rows, or as JSON and SARIF lines by
    ``documents``, without passing the driver.
    """
    rel = scan.relations
    found = findings.findings(rel, config).persist()
    notes = scan.diagnostics.orderBy("file", "line", "column", "code").collect()
    summary = findings.summarise(found, rel, config, scan.files_scanned, len(notes)).first().asDict(recursive=True)
    by_rule = summary.pop("by_rule") or {}
    files = rel.env_files.drop("byte_size").orderBy("path").collect()
    ordered = found.orderBy(*findings.by_order()).collect()
    found.unpersist()
    return Report(
        root=scan.root,
        findings=[plain(r, drop_null=True) for r in ordered],
        summary={camel(k): v for k, v in summary.items()} | {"byRule": by_rule},
        files=[plain(r) for r in files],
        variables=[plain(r) for r in rollup.variables(rel, config, include_undeclared=True, redact=redact).collect()],
        files_scanned=scan.files_scanned,
        bytes_scanned=scan.bytes_scanned,
        skipped=scan.skipped,
        diagnostics=[plain(r) for r in notes],
        counts={n: getattr(rel, n).count() for n in ("usages", "decls", "infra")},
    )


def grouped(found: DataFrame, by: str) -> DataFrame:
    """(key, count, findings) of findings in order: the positions of each group's findings, by file, rule or variable."""
    key = {"file": F.col("file"), "rule": F.col("rule_id"), "variable": F.coalesce("variable", F.lit(""))}[by]
    return (
        found.groupBy(key.alias("key"))
        .agg(F.count("*").alias("count"), F.array_sort(F.collect_list("position")).alias("findings"))
        .orderBy("key")
    )
