"""Reports for terminals."""

from __future__ import annotations

from envlattice.operators.catalogue import DOCS
from envlattice.sinks.report import Report

CLEAN = "no problems found"
_CODES = {"error": "31", "warn": "33", "info": "36", "bold": "1", "dim": "2", "good": "32"}
_WORDS = {"error": "error", "warn": "warning", "info": "info"}


def _n(count: int, word: str) -> str:
    return f"{count} {word}{'' if count == 1 or word == 'info' else 's'}"


def summary_line(report: Report) -> str:
    s = report.summary
    parts = [_n(s[k], w) for k, w in _WORDS.items() if s[k]]
    return f"{', '.join(parts)} · {_n(s['total'], 'finding')} in {_n(s['filesWithFindings'], 'file')}" if parts else CLEAN


def render(report: Report, label: str = ".", limit: int = 20, short: bool = False, color: bool = False) -> str:
    """Findings by file, at most ``limit`` a file, with hints; or one line each."""
    paint = lambda text, kind: f"\x1b[{_CODES[kind]}m{text}\x1b[0m" if color else text
    head = [f"{report.tool['name']} {report.tool['version']}", label]
    head += [_n(report.files_scanned, "file")] * bool(report.files_scanned)
    head += [_n(report.summary["variables"], "variable")] * bool(report.summary["variables"])
    head += [f"{report.duration_ms} ms"] * bool(report.duration_ms)
    out = [" · ".join(head), ""]
    if not report.findings:
        line = summary_line(report)
        return "\n".join([*out, paint(f"✓ {line}", "good") if line == CLEAN else line]) + "\n"
    width = max(len(f["ruleId"]) for f in report.findings)
    by_file: dict[str, list[dict]] = {}
    for f in report.findings:
        by_file.setdefault(f["file"], []).append(f)

    def line(f: dict) -> list[str]:
        at = f"{f['file']}:{f['line']}:{f['column']}"
        first = f"{paint(at, 'dim')}  {paint(f['severity'].ljust(5), f['severity'])}  {paint(f['ruleId'].ljust(width), 'bold')}  {f['message']}"
        hint = f.get("hint") and not short
        return [first, *([" " * (len(at) + width + 11) + paint(f"hint: {f['hint']}", "dim")] if hint else [])]

    more = lambda n: [paint(f"… and {n} more in this file", "dim")] if n > 0 else []
    if short:
        left = {}
        for f in report.findings:
            left[f["file"]] = left.get(f["file"], 0) + 1
            out += line(f) if left[f["file"]] <= limit else []
        for file in sorted(left):
            out += more(left[file] - limit)
    else:
        for i, file in enumerate(sorted(by_file)):
            out += [""] * (i > 0) + [x for f in by_file[file][:limit] for x in line(f)] + more(len(by_file[file]) - limit)
    if len({f["ruleId"] for f in report.findings}) > 1:
        out.append(paint(f"docs: {DOCS}", "dim"))
    out += ["", summary_line(report)]
    return "\n".join(out) + "\n"


def why(report: Report, name: str) -> str | None:
    """All that is known of one variable, or None if nothing is."""
    v = next((x for x in report.variables if x["name"] == name), None)
    if v is None:
        return None
    tags = ["required" if v["required"] else "optional"]
    tags += [t for t, on in (("secret", v["secretish"]), ("weak value", v["hasWeakValue"]), ("undeclared", not v["declaredIn"]), ("never read", not v["readIn"])) if on]
    out = [f"{name}  [{', '.join(tags)}]", *([f"  {v['description']}"] if v["description"] else [])]

    def section(title: str, lines: list[str]) -> None:
        if lines:
            out.extend(["", f"  {title}", *(f"    {x}" for x in lines)])

    flags = lambda d: ", ".join(["shared" if d["shared"] else "local", *(["conflicts"] if d["conflicting"] else [])])
    section("declared in", [f"{d['file']}:{d['line']}  {d['preview'] or '(empty)'}  {flags(d)}" for d in v["values"]])
    mode = lambda r: "no default" if r["required"] else "has default" if r["hasFallback"] else "optional"
    section("read in", [f"{r['file']}:{r['line']}  {r['accessor']}  {mode(r)}" for r in v["readIn"]])
    section("referenced in", [f for f in v["referencedIn"] if f not in {r["file"] for r in v["readIn"]}])
    section("names in CI", v["ciNames"])
    own = [f for f in report.findings if f.get("variable") == name]
    section("findings", [f"{f['severity']:5}  {f['ruleId']:28}  {f['file']}:{f['line']}:{f['column']}  {f['message']}" for f in own])
    return "\n".join(out) + "\n"
