"""JSON, SARIF and markdown documents, and the example skeleton."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlattice.operators import catalogue
from envlattice.sinks.report import NAME, Report, camel, dumps

_RANK = {s: i for i, s in enumerate(catalogue.SEVERITIES)}
_LEVEL = {"error": "error", "warn": "warning", "info": "note"}
_ROOT = "PROJECTROOT"
CELL, PATHS, EMPTY = 60, 3, "—"


def _group_key(f: dict, by: str) -> str:
    return {"file": f["file"], "rule": f["ruleId"], "variable": f.get("variable", "")}[by]


def to_json(
    report: Report, label: str | None = None, pretty: bool = True, group_by: str = "none", skipped: bool = False, variables: bool = True
) -> str:
    """The whole report as one document; keys are sorted and absent values left out of findings."""
    order = lambda f: (-_RANK[f["severity"]], f["file"], f["line"], f["column"], f["ruleId"])
    found = sorted(report.findings, key=order)
    groups: dict[str, list[int]] = {}
    if group_by != "none":
        for i, f in enumerate(found):
            groups.setdefault(_group_key(f, group_by), []).append(i)
    out = {
        "schemaVersion": 1, "tool": report.tool, "root": label or report.root, "durationMs": report.duration_ms,
        "summary": report.summary, "files": report.files,
        "variables": [v for v in report.variables if v["declaredIn"]] if variables else [], "findings": found,
        "groups": [{"key": k, "count": len(v), "findings": v} for k, v in sorted(groups.items())],
    }
    if skipped:
        out["skipped"] = [{"file": f, "reason": r} for f, r in report.skipped]
    return dumps(out, pretty)


def to_json_summary(report: Report, label: str | None = None, pretty: bool = True) -> str:
    return dumps({"schemaVersion": 1, "tool": report.tool, "root": label or report.root, "summary": report.summary}, pretty)


def json_lines(found: DataFrame) -> DataFrame:
    """(file, line, json): a finding a row, as the document has it, for results that no driver should gather."""
    keys = sorted((camel(c), c) for c in found.columns)
    return found.select("file", "line", F.to_json(F.struct(*(F.col(c).alias(k) for k, c in keys))).alias("json"))


def sarif_lines(found: DataFrame) -> DataFrame:
    """(file, line, json): a SARIF result a row, without the index of its rule's descriptor."""
    flat = F.regexp_replace(F.regexp_replace(F.translate("file", "\\", "/"), "^[A-Za-z]:/", ""), r"^/+", "")
    uri = F.coalesce(F.nullif(F.regexp_replace(flat, r"^\./", ""), F.lit("")), F.lit("unknown"))
    line, column = F.greatest(F.lit(1), "line"), F.greatest(F.lit(1), "column")
    levels = F.element_at(F.create_map(*(F.lit(x) for pair in _LEVEL.items() for x in pair)), F.col("severity"))
    region = F.struct(column.alias("startColumn"), line.alias("startLine"))
    place = F.struct(F.struct(uri.alias("uri"), F.lit(_ROOT).alias("uriBaseId")).alias("artifactLocation"), region.alias("region"))
    message = [F.struct(F.col("message").alias("text")).alias("message")] if "message" in found.columns else []
    optional = [c for c in ("fingerprint", "hint", "variable") if c in found.columns]
    result = F.struct(
        levels.alias("level"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"), *message,
        F.struct(F.concat_ws(":", "rule_id", uri, line.cast("string"), column.cast("string")).alias(f"{NAME}/v1")).alias("partialFingerprints"),
        F.struct(*optional).alias("properties"), F.col("rule_id").alias("ruleId"),
    )
    return found.select("file", "line", F.to_json(result).alias("json"))


def relative_uri(path: str) -> str:
    """A path without drive, leading slashes or a leading dot, so that no absolute path is published."""
    path = re.sub(r"^[A-Za-z]:/", "", path.replace("\\", "/")).lstrip("/")
    return path.removeprefix("./") or "unknown"


def to_sarif(report: Report, label: str = ".", information_uri: str = "") -> str:
    """SARIF 2.1.0: a descriptor for each rule that fired, at its highest severity, and a result for each finding."""
    fired: dict[str, dict] = {}
    for f in report.findings:
        have = fired.setdefault(f["ruleId"], dict(f))
        if _RANK[f["severity"]] > _RANK[have["severity"]]:
            have["severity"] = f["severity"]
    ids = sorted(fired)
    tags = {i: tag for i, _, tag, *_ in catalogue.RULES}
    fix = {i: text for i, _, _, _, text in catalogue.RULES}
    rules = [
        {
            "id": i, "name": i.replace("-", "_"), "shortDescription": {"text": fired[i]["ruleTitle"]},
            "fullDescription": {"text": fix.get(i, fired[i]["ruleTitle"])}, "helpUri": fired[i]["docsUrl"],
            "defaultConfiguration": {"level": _LEVEL[fired[i]["severity"]]},
            "properties": {"tags": [tags.get(i, "correctness")], f"{NAME}/severity": fired[i]["severity"]},
        }
        for i in ids
    ]

    def result(f: dict) -> dict:
        uri, line, column = relative_uri(f["file"]), max(1, f["line"]), max(1, f["column"])
        region = {"startLine": line, "startColumn": column}
        return {
            "ruleId": f["ruleId"], "ruleIndex": ids.index(f["ruleId"]), "level": _LEVEL[f["severity"]], "message": {"text": f["message"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": uri, "uriBaseId": _ROOT}, "region": region}}],
            "partialFingerprints": {f"{NAME}/v1": f"{f['ruleId']}:{uri}:{line}:{column}"},
            "properties": {k: f[k] for k in ("variable", "hint", "fingerprint") if k in f},
        }

    driver = {"name": report.tool["name"], "version": report.tool["version"], "semanticVersion": report.tool["version"], "rules": rules}
    driver |= {"informationUri": information_uri} if information_uri else {}
    run = {
        "tool": {"driver": driver}, "originalUriBaseIds": {_ROOT: {"uri": f"file:///{relative_uri(label)}/"}},
        "invocations": [{"executionSuccessful": True}], "results": [result(f) for f in report.findings],
    }
    return dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}) + "\n"


def cell(value: str | None) -> str:
    """A markdown cell: one line, marks escaped, of bounded length; a dash for nothing."""
    if not value:
        return EMPTY
    text = re.sub(r"\r?\n", " ", value).replace("|", "\\|").replace("`", "\\`")
    return text if len(text) <= CELL else text[: CELL - 1] + "…"


def list_cell(values: list[str]) -> str:
    hidden = len(values) - PATHS
    return cell(", ".join(values[:PATHS]) + (f", +{hidden} more" if hidden > 0 else ""))


def _table(head: list[str], rows: list[list[str]]) -> list[str]:
    return [f"| {' | '.join(r)} |" for r in (head, ["---"] * len(head), *rows)]


def to_markdown(report: Report, label: str = ".", title: str = "Environment variables", with_findings: bool = False, with_empty: bool = False) -> str:
    """Counts, rules that fired and a row for every variable, those that are only read too."""
    s = report.summary
    out = [f"# {title}", "", f"{report.tool['name']} {report.tool['version']} · {label} · {report.files_scanned} files · {s['variables']} variables", ""]
    out += _table(["Severity", "Count"], [[k, str(s[k])] for k in reversed(catalogue.SEVERITIES)])
    worst: dict[str, str] = {}
    for f in report.findings:
        worst[f["ruleId"]] = max(worst.get(f["ruleId"], "info"), f["severity"], key=_RANK.get)
    if worst:
        out += ["", *_table(["Rule", "Severity", "Count"], [[cell(r), worst[r], str(s["byRule"].get(r, 0))] for r in sorted(worst)])]
    shown = [v for v in report.variables if with_empty or v["declaredIn"] or v["readIn"]]
    rows = [
        [
            cell(v["name"]), "yes" if v["required"] else "no", list_cell(v["declaredIn"]), list_cell(sorted({r["file"] for r in v["readIn"]})),
            cell(v["values"][0]["preview"]) if v["values"] else EMPTY, cell(v["description"]),
        ]
        for v in shown
    ]
    head = ["Variable", "Required", "Declared in", "Read in", "Default", "Description"]
    out += ["", *(_table(head, rows) if rows else ["No environment variables found."])]
    if with_findings and report.findings:
        out += ["", "## Findings"]
        for rule in sorted(worst):
            own = [f for f in report.findings if f["ruleId"] == rule]
            out += ["", f"### {rule}", "", cell(own[0]["ruleTitle"]), "", f"{worst[rule]} · {len(own)} findings", ""]
            out += _table(["File", "Line", "Message"], [[cell(f["file"]), str(f["line"]), cell(f["message"])] for f in own])
    return "\n".join(out) + "\n"


def to_example(report: Report) -> str:
    """An example file of all names that can be set, required ones first; values are always empty."""
    out = [f"# Made by {report.tool['name']} {report.tool['version']}.", "# Keep real secrets out of this file.", "", "# --- required ---"]
    named = [v for v in report.variables if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", v["name"])]
    for title, wanted in ((None, True), ("# --- optional ---", False)):
        out += ["", title] if title else []
        for v in named:
            if v["required"] == wanted:
                out += ["# a secret: never commit its value"] * v["secretish"] + [f"# {v['description']}"] * bool(v["description"])
                out += [f"# read in {r['file']}:{r['line']}" for r in v["readIn"][:1]] + [f"{v['name']}="]
    return "\n".join(out) + "\n"
