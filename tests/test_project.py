"""A whole project: relations, findings, sinks and the command line."""

import io
import json
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from envlattice import cli
from envlattice.config import Config, load, resolve, strip_comments
from envlattice.operators import findings, rollup
from envlattice.sinks import documents, dotenv, report, text
from envlattice.sources import project

KEY = "AKIA" + "QCN5VJTUYMSSXKC6"
FILES = {
    "src/app.js": "const a = process.env.PORT ?? 3000;\nconst t = process.env.API_TOKEN || 'f33e61083db5dbdf4bd2369d2f80176e57f7fda2';\n"
    "process.env.UNDECLARED;\nprocess.env.SKIPPED; // envlattice-disable-line missing-in-env\ndotenv.config({ path: '.env.gone' });\n",
    "app.py": "import os\nos.environ['LOCAL_ONLY']\nos.environ['PATH']\n",
    ".env": f"# the port\nPORT=1\nPORT=2 # again\nexport AWS_ID={KEY}\nDEBUG=true\nEMPTY=\nWORDS=a b $HOME\nlower=1\nNODE_OPTIONS=x\nREACT_APP_X=1\nnot valid\nDATABASE_URL=postgres://u:changeme@h/d\nSITE=https://u:s3cretpw99@h/\n",
    ".env.example": "PORT=\nGHOST=\nAPI_TOKEN=changeme\n",
    ".env.local": "LOCAL_ONLY=1\nPORT=3\n",
    "docker-compose.yml": "services:\n  web:\n    env_file: .env, missing.env, .env.local\n    environment:\n      SET: 1\n    image: ${IMG:?need} ${SET} ${TAG:-x}\n",
    "Dockerfile": "ARG V=1\nENV E=$V\n",
    ".github/workflows/ci.yml": "env:\n  CI_SET: 1\njobs:\n  x:\n    steps:\n    - run: echo ${{ secrets.DEPLOY_TOKEN }}\n",
    "package.json": '{"name": "p", "dependencies": {"Vite": "1"}}',
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("project")
    for name, body in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(body)
    return top


@pytest.fixture(scope="module")
def scanned(spark, root):
    return project.scan(spark, str(root), Config())


@pytest.fixture(scope="module")
def built(scanned):
    return report.build(scanned, Config())


def places(built):
    return {(f["ruleId"], f["file"], f["line"], f.get("variable")) for f in built.findings}


def test_findings(built):
    found = places(built)
    want = {
        ("missing-in-env", "src/app.js", 3, "UNDECLARED"), ("prod-crash", "app.py", 2, "LOCAL_ONLY"), ("duplicate-key", ".env", 3, "PORT"),
        ("example-out-of-sync", ".env.example", 2, "GHOST"), ("ci-secret-undeclared", ".github/workflows/ci.yml", 6, "DEPLOY_TOKEN"),
        ("compose-var-undeclared", "docker-compose.yml", 6, "IMG"), ("compose-var-undeclared", "docker-compose.yml", 6, "TAG"),
        ("env-file-missing", "docker-compose.yml", 3, None), ("env-file-missing", "src/app.js", 5, None),
        ("env-file-untracked", "docker-compose.yml", 3, None), ("framework-prefix-mismatch", ".env", 10, "REACT_APP_X"),
        ("conflicting-values", ".env.local", 2, "PORT"), ("empty-value", ".env", 6, "EMPTY"), ("unquoted-special-chars", ".env", 7, "WORDS"),
        ("inline-comment-truncation", ".env", 3, "PORT"), ("export-prefix", ".env", 4, "AWS_ID"), ("unterminated-quote", ".env", 11, None),
        ("expansion-unsupported", ".env", 7, "WORDS"), ("invalid-name", ".env", 8, "lower"), ("hostile-name", ".env", 9, "NODE_OPTIONS"),
        ("hostile-name", "app.py", 3, "PATH"), ("secret-in-repo", ".env", 4, "AWS_ID"), ("secret-fallback-literal", "src/app.js", 2, "API_TOKEN"),
        ("debug-flag-shared-env", ".env", 5, "DEBUG"), ("hardcoded-connection-string", ".env", 13, "SITE"), ("missing-from-example", ".env", 4, "AWS_ID"),
        ("unused-variable", ".env", 4, "AWS_ID"),
    }
    assert want <= found, want - found
    assert not {f for f in found if f[3] in ("SKIPPED", "SET", "CI_SET", "E", "V") and f[0] == "missing-in-env"}
    assert ("missing-in-env", "src/app.js", 1, "PORT") not in found and ("weak-secret", ".env.example", 3, "API_TOKEN") not in found
    severity = {(f["ruleId"], f.get("variable")): f["severity"] for f in built.findings}
    assert severity["compose-var-undeclared", "IMG"] == "error" and severity["compose-var-undeclared", "TAG"] == "info"
    assert severity["hostile-name", "NODE_OPTIONS"] == "error" and severity["hostile-name", "PATH"] == "info"
    rank = {"error": 0, "warn": 1, "info": 2}
    order = [(rank[f["severity"]], f["file"], f["line"], f["column"], f["ruleId"]) for f in built.findings]
    assert order == sorted(order)
    assert built.summary["total"] == len(built.findings) == sum(built.summary["byRule"].values())


def test_no_secret_in_any_sink(built):
    everything = documents.to_json(built, skipped=True) + documents.to_sarif(built) + documents.to_markdown(built, with_findings=True) + text.render(built)
    everything += documents.to_example(built) + "".join(filter(None, (text.why(built, v["name"]) for v in built.variables)))
    for secret in (KEY, "f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "s3cretpw99"):
        assert secret not in everything


def test_variables(scanned, built):
    by = {v["name"]: v for v in built.variables}
    assert by["PORT"]["declaredIn"] == [".env", ".env.example", ".env.local"] and by["PORT"]["description"] == "the port"
    assert by["PORT"]["kind"] == "example" and all(v["conflicting"] for v in by["PORT"]["values"])
    assert by["LOCAL_ONLY"]["required"] and by["API_TOKEN"]["secretish"] and by["DEPLOY_TOKEN"]["ciNames"] == ["DEPLOY_TOKEN"]
    assert by["SET"]["infraKinds"] == ["compose-environment", "compose-interpolation"]
    only = {r["name"] for r in rollup.variables(scanned.relations, include_undeclared=False, include_unused=False).collect()}
    assert "PORT" in only and "GHOST" not in only and "UNDECLARED" not in only


def test_documents(built):
    doc = json.loads(documents.to_json(built, "p", group_by="rule", skipped=True))
    assert doc["schemaVersion"] == 1 and doc["root"] == "p" and sum(g["count"] for g in doc["groups"]) == len(doc["findings"])
    assert json.loads(documents.to_json_summary(built))["summary"] == doc["summary"]
    assert documents.to_json(built) == documents.to_json(built)
    sarif = json.loads(documents.to_sarif(built, ".", "https://example.org"))["runs"][0]
    rules = sarif["tool"]["driver"]["rules"]
    assert [r["id"] for r in rules] == sorted(doc["summary"]["byRule"]) and all(rules[r["ruleIndex"]]["id"] == r["ruleId"] for r in sarif["results"])
    assert documents.relative_uri("C:\\a\\b") == "a/b" and documents.relative_uri("/") == "unknown"
    md = documents.to_markdown(built, with_findings=True)
    assert "| PORT | no | .env, .env.example, .env.local | src/app.js |" in md and "### duplicate-key" in md
    assert documents.cell("a|b`\n" + "x" * 99).startswith("a\\|b\\` x") and documents.list_cell(list("abcde")) == "a, b, c, +2 more"
    example = documents.to_example(built)
    required, optional = example.split("# --- optional ---")
    assert "LOCAL_ONLY=" in required and "LOCAL_ONLY=" not in optional and "# the port\n# read in src/app.js:1\nPORT=" in example


def test_text(built):
    plain = text.render(built, ".", limit=2)
    assert "… and" in plain and "\x1b[" not in plain and text.summary_line(built) in plain and "\x1b[31m" in text.render(built, color=True)
    assert len(text.render(built, short=True).splitlines()) < len(text.render(built, limit=100).splitlines())
    assert text.why(built, "NOPE") is None and "[optional" in text.why(built, "PORT")


def test_groups(spark, built):
    rows = [(i, f["file"], f["ruleId"], f.get("variable")) for i, f in enumerate(built.findings)]
    df = spark.createDataFrame(rows, "position int, file string, rule_id string, variable string")
    got = {r.key: r.findings for r in report.grouped(df, "rule").collect()}
    assert got["duplicate-key"] == [i for i, f in enumerate(built.findings) if f["ruleId"] == "duplicate-key"]


def test_own_rules_severities_and_suppressions(spark, scanned):
    config = resolve({"severities": {"empty-value": "error", "nope": "error"}, "ignoreRules": ["unused-variable"], "ignoreVariables": ["por*"]})
    assert len(config.warnings) == 1
    found = findings.findings(scanned.relations, config).collect()
    assert {r.severity for r in found if r.rule_id == "empty-value"} == {"error"}
    assert not any(r.rule_id == "unused-variable" or r.variable == "PORT" for r in found)
    extra = lambda rel, config: findings.RULES["empty-value"](rel, config).withColumn("rule_id", F.lit("own-rule"))
    own = findings.resolve(findings.raw_findings(scanned.relations, config, {"own-rule": extra}), scanned.relations, config, [("own-rule", "Own", "info")])
    assert [(r.severity, r.rule_title) for r in own.where("rule_id = 'own-rule'").collect()] == [("info", "Own")]


def test_what_bounds_leave_out_is_said(spark, tmp_path, monkeypatch):
    from envlattice.sources import accessors, markers

    (tmp_path / "a.js").write_text("process.env.PORT; // " + "x" * 200)
    (tmp_path / "b.txt").write_text("y" * 120)
    (tmp_path / "package.json").write_text("{}")
    (tmp_path / "p/q").mkdir(parents=True)
    monkeypatch.setattr(accessors, "MAX_BYTES", 150)
    monkeypatch.setattr(markers, "MAX_BYTES", 100)
    monkeypatch.setattr(project, "MANIFEST_DEPTH", 1)
    scan = project.scan(spark, str(tmp_path))
    assert {("a.js", "too-large-for-reads"), ("a.js", "too-large-for-markers"), ("b.txt", "too-large-for-markers"), ("p/q", "manifests-too-deep")} <= set(scan.skipped)
    scan.release()
    monkeypatch.setattr(project, "MANIFESTS", 1)
    left_out = []
    project.read_manifest(str(tmp_path), left_out)
    assert left_out == [("p", "manifests-too-many")]


def test_clean_project_has_no_findings(spark, tmp_path):
    (tmp_path / "a.js").write_text("process.env.PORT")
    (tmp_path / ".env").write_text("PORT=1\n")
    (tmp_path / ".env.example").write_text("PORT=\n")
    assert findings.findings(project.scan(spark, str(tmp_path)).relations).collect() == []


def run(spark, root, *argv):
    out, err = io.StringIO(), io.StringIO()
    return cli.main(list(argv), out, err, str(root), spark), out.getvalue(), err.getvalue()


def test_command_line(spark, root, tmp_path):
    here = tmp_path / "p"
    shutil.copytree(root, here)
    code, out, err = run(spark, here, "--verbose", "--max-issues=1")
    assert code == 1 and "more in this file" in out and "skipped:" in err
    assert run(spark, here, "check", "--fail-on", "none", "--quiet")[:2] == (0, "")
    code, out, _ = run(spark, here, "--format", "json", "--rule", "empty-value", "--fail-on=error")
    assert code == 0 and {f["ruleId"] for f in json.loads(out)["findings"]} == {"empty-value"}
    assert run(spark, here, "why", "PORT")[0] == 0 and run(spark, here, "why")[0] == 2
    assert run(spark, here, "init", "--write")[0] == 2
    assert run(spark, here, "init", "--write", "new.env")[0] == 0 and "PORT=" in (here / "new.env").read_text()
    assert run(spark, here, "docs", "--write", "--dry-run")[2].startswith("dry run") and not (here / "docs").exists()
    assert run(spark, here, "docs", "--write")[0] == 0 and (here / "docs/environment.md").exists()
    assert run(spark, here, "fmt")[0] == 1 and run(spark, here, "fmt", "--write")[0] == 0 and run(spark, here, "fmt")[0] == 0
    assert "28 rules" in run(spark, here, "rules")[1] and json.loads(run(spark, here, "rules", "--json")[1])["count"] == 28
    assert run(spark, here, "version")[1] and "scan" in run(spark, here, "--help")[1]
    for bad in (["--nope"], ["--format", "x"], ["--format"], ["--quiet=1"], ["--rule", "x"], ["--max-issues", "0"], ["init", "x"], ["--fail-on", "x"]):
        assert run(spark, here, *bad)[0] == 2
    assert cli.parse(["--", "--x"]).positional == ["--x"]


def test_git_decides_what_is_committed(spark, root, tmp_path):
    here = tmp_path / "g"
    shutil.copytree(root, here)
    git = lambda *a: subprocess.run(["git", "-C", str(here), *a], check=True, capture_output=True)
    git("init")
    git("add", ".env.example")
    rel = project.scan(spark, str(here)).relations
    assert {r.path: r.committed for r in rel.env_files.where("exists").collect()} == {".env": False, ".env.example": True, ".env.local": False}
    found = findings.RULES["secret-in-repo"](rel, Config()).collect()
    assert {(r.variable, r.severity) for r in found} >= {("AWS_ID", "warn")}


def test_config(tmp_path):
    body = '{ // c\n "failOn": "warn", /* x */ "weakValues": ["Zed",], "secretPatterns": [{"id": "own", "name": "Own", "pattern": "zz+", "test": "zzz"}, {"id": "bad", "name": "B", "pattern": "(" }, {"id": "t", "name": "T", "pattern": "a", "test": "b"}], "nope": 1, "maxFileSizeKb": -1 }'
    (tmp_path / ".envlatticerc.json").write_text(body)
    (tmp_path / "sub").mkdir()
    config = load(str(tmp_path / "sub"))
    assert config.fail_on == "warn" and "zed" in config.weak_values and ("own", "Own", "zz+") in config.secret_patterns
    assert len(config.warnings) == 4 and config.source.endswith(".envlatticerc.json")
    assert load(str(tmp_path), overrides={"failOn": "info"}).fail_on == "info" and load(str(tmp_path), str(tmp_path / "no.json")).warnings
    assert json.loads(strip_comments('{"a": "// no", /* c */ "b": [1,],}')) == {"a": "// no", "b": [1]}


def test_dotenv_round_trip(spark, scanned):
    from envlattice.sources import dotenv as reader

    body = "# a\n# b\nexport A='x y' # t\nB=\"1\\n2\"\nC=plain\nD=\nE=$X/y\n"
    decls = spark.createDataFrame([{**d, "file": "f"} for d in reader.parse("f", body).decls], scanned.relations.decls.schema)
    assert dotenv.serialize(decls).first().text == body
    assert dotenv.serialize(decls, style="double").first().text.splitlines()[2] == 'export A="x y" # t'
    two = spark.createDataFrame([{**d, "file": "f"} for d in reader.parse("f", "A=1\nB=2\nA=3\n").decls], scanned.relations.decls.schema)
    assert dotenv.serialize(two, dedupe="keep-last", header=("top",), eol="\r\n").first().text == "# top\r\n\r\nB=2\r\nA=3\r\n"
    assert dotenv.serialize(two, dedupe="keep-first").first().text == "A=1\nB=2\n"


def test_format_text():
    assert dotenv.format_text("B=1 \n# c\nA=2\n\nD=1\nC=2") == ("# c\nA=2\nB=1\n\nC=2\nD=1\n", ["blanks at line ends", "order of keys", "last line end"])
    assert dotenv.format_text("B=1\nA=1\nB=2\n")[0] == "A=1\nB=1\nB=2\n"
    assert dotenv.format_text("") == ("", []) and dotenv.format_text("A=1\r\n") == ("A=1\r\n", [])
    once = dotenv.format_text("Z=1\nY=\"a\nb\"\n#x\n\nA=1 ")[0]
    assert dotenv.format_text(once)[0] == once
