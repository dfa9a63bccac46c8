"""Readers of single files."""

import time

import pytest

from envlattice.sources import accessors, ci, compose, dockerfile, dotenv, ignore, markers, tree
from envlattice.sources.references import braced, interpolations

READS = [
    # language, text, (name, line, column, accessor, fallback, required, literal)
    ("javascript", "process.env.API", ("API", 1, 13, "process.env", False, False, None)),
    ("typescript", "globalThis.process?.env?.API ?? 'x'", ("API", 1, 26, "process.env", True, False, "x")),
    ("javascript", "process.env['API'] || \"y\"", ("API", 1, 13, "process.env", True, False, "y")),
    ("javascript", "const { API = 'd' } = process.env", ("API", 1, 9, "process.env", True, False, "d")),
    ("javascript", "const { 'API': a } = process.env", ("API", 1, 9, "process.env", False, False, None)),
    ("javascript", "import.meta.env.VITE_A", ("VITE_A", 1, 17, "import.meta.env", False, False, None)),
    ("javascript", "Bun.env.API", ("API", 1, 9, "Bun.env", False, False, None)),
    ("typescript", "Deno.env.get('API', 'z')", ("API", 1, 14, "Deno.env.get", True, False, "z")),
    ("typescript", "import { API } from '$env/static/public'", ("API", 1, 10, "$env/static/public", False, True, None)),
    ("javascript", "`${process.env.API}`", ("API", 1, 16, "process.env", False, False, None)),
    ("python", "os.environ['API']", ("API", 1, 12, "os.environ", False, True, None)),
    ("python", "os.environ.get('API', 'x')", ("API", 1, 16, "os.environ", True, False, "x")),
    ("python", "os.environ.setdefault('API', 'x')", ("API", 1, 23, "os.environ", True, False, "x")),
    ("python", "x = os . getenv( \"API\" )", ("API", 1, 18, "os.getenv", False, False, None)),
    ("python", "from os import environ\nenviron['API']", ("API", 2, 9, "os.environ", False, True, None)),
    ("python", "from os import environ as e\ne.get('API', 'q')", ("API", 2, 7, "os.environ", True, False, "q")),
    ("python", "class S(BaseSettings):\n    api: str = 'x'\n", ("api", 2, 5, "BaseSettings", True, False, "x")),
    ("python", "class S(BaseSettings):\n    api: int\n    model_x: int\n", ("api", 2, 5, "BaseSettings", False, True, None)),
    ("go", 'os.Getenv("API")', ("API", 1, 11, "os.Getenv", False, False, None)),
    ("go", 'import "os"\nGetenv(`API`)', ("API", 2, 8, "os.Getenv", False, False, None)),
    ("go", 'os.LookupEnv("API")', ("API", 1, 14, "os.LookupEnv", True, False, None)),
    ("rust", 'std::env::var("API").expect("x")', ("API", 1, 15, "env::var", False, True, None)),
    ("rust", 'env::var("API").unwrap_or("x".into())', ("API", 1, 10, "env::var", True, False, "x")),
    ("rust", 'use std::env::var;\nvar("API").ok()', ("API", 2, 5, "env::var", True, False, None)),
    ("java", 'System.getenv("API")', ("API", 1, 15, "System.getenv", False, False, None)),
    ("kotlin", 'System.getenv().get("API")', ("API", 1, 21, "System.getenv", False, False, None)),
    ("java", 'System.getProperty("API", "x")', ("API", 1, 20, "System.getProperty", True, False, "x")),
    ("csharp", 'Environment.GetEnvironmentVariable("API")', ("API", 1, 36, "Environment.GetEnvironmentVariable", False, False, None)),
    ("csharp", 'builder.Configuration["API"]', ("API", 1, 23, "IConfiguration", False, False, None)),
    ("csharp", 'config.GetConnectionString("API")', ("API", 1, 28, "GetConnectionString", False, True, None)),
    ("ruby", "ENV['API'] || 'x'", ("API", 1, 5, "ENV", True, True, "x")),
    ("ruby", "ENV.fetch('API') { 'x' }", ("API", 1, 11, "ENV.fetch", True, True, "x")),
    ("php", "getenv('API')", ("API", 1, 8, "getenv", False, False, None)),
    ("php", "$_ENV['API']", ("API", 1, 7, "$_ENV", False, False, None)),
    ("php", "$_SERVER['API']", ("API", 1, 10, "$_SERVER", False, False, None)),
    ("php", "env('API', 'x')", ("API", 1, 5, "env", True, False, "x")),
    ("perl", "$ENV{API} // 'x'", ("API", 1, 6, "%ENV", True, False, "x")),
    ("perl", "$ENV{'API'}", ("API", 1, 6, "%ENV", False, False, None)),
    ("shell", 'echo "$API"', ("API", 1, 8, "shell-parameter", False, False, None)),
    ("shell", "${API:-x}", ("API", 1, 3, "shell-parameter", True, False, "x")),
    ("shell", "${API:?needed}", ("API", 1, 3, "shell-parameter", False, True, None)),
    ("shell", "printenv API", ("API", 1, 10, "printenv", False, True, None)),
    ("batch", "echo %API%", ("API", 1, 7, "batch-parameter", False, False, None)),
    ("batch", "if not defined API exit", ("API", 1, 16, "batch-parameter", False, False, None)),
    ("swift", 'ProcessInfo.processInfo.environment["API"]', ("API", 1, 37, "ProcessInfo.processInfo.environment", False, False, None)),
    ("swift", 'import Foundation\nlet x = environment["API"]', ("API", 2, 21, "ProcessInfo.processInfo.environment", False, False, None)),
    ("dart", "Platform.environment['API']", ("API", 1, 22, "Platform.environment", False, False, None)),
    ("dart", "String.fromEnvironment('API', 'x')", ("API", 1, 24, "String.fromEnvironment", True, False, "x")),
    ("elixir", 'System.get_env("API")', ("API", 1, 16, "System.get_env", False, False, None)),
    ("elixir", 'System.fetch_env("API")', ("API", 1, 18, "System.fetch_env", False, False, None)),
    ("elixir", 'System.fetch_env!("API")', ("API", 1, 19, "System.fetch_env", False, True, None)),
]


@pytest.mark.parametrize(("language", "text", "want"), READS)
def test_a_read(language, text, want):
    found = accessors.scan("f", text, language)
    assert [(r[0], r[2], r[3], r[5], r[6], r[7], r[9]) for r in found] == [want]


@pytest.mark.parametrize(
    ("language", "text"),
    [
        ("javascript", "// process.env.A\n/* process.env.B */ 'process.env.C' `process.env.D`"),
        ("javascript", "import.meta.env.MODE; x.process.env.A; myprocess.env.A"),
        ("python", "# os.getenv('A')\n'''os.getenv(\"B\")'''\nos.environ['C'] = 1\nos.environ['D'] += 'x'"),
        ("go", 'Getenv("A")  // no import'),
        ("rust", '/* /* */ env::var("A") */ my::env::var("B")'),
        ("swift", 'environment["A"]'),
        ("shell", "# $AA\necho '$BB' \\$CC $$DD"),
        ("batch", "rem %AA%\n:: %BB%\necho %PATH%"),
        ("ruby", "ENV['A'] = 1\n# ENV['B']"),
        ("csharp", '@"a "" Environment.GetEnvironmentVariable(""X"")"'),
        ("unknown", "process.env.A"),
    ],
)
def test_no_read(language, text):
    assert accessors.scan("f", text, language) == []


def test_all_accessors_are_there():
    assert len(list(accessors.ids())) == 41


def test_columns_count_utf16_units():
    assert accessors.scan("f", "'🙂'; process.env.A", "javascript")[0][3] == 19


def test_dotenv():
    text = "﻿# one\n#two\nA=1\r\n\n# gone\n\nexport B = \"x\\ty\\x41\\q${A}\nmore\" # tail\nB=2 # why\nC=#no\nD= #yes\nE\n\nF=a#b \nG='$X\\n' junk\nbad key=1\nH\nx=1\nI=$$A \\$B $CC $cc ${DD:-1}$CC"
    found = dotenv.parse("p/.env", text)
    by = {(d["name"], d["line"]): d for d in found.decls}
    assert by["A", 3]["leading_comments"] == ["one", "two"] and by["A", 3]["value"] == "1"
    b = by["B", 7]
    assert (b["value"], b["exported"], b["quoted"], b["inline_comment"], b["leading_comments"], b["references"], b["column"]) == (
        "x\tyA\\q${A}\nmore", True, '"', "tail", [], ["A"], 8)
    assert by["B", 9]["duplicate_of_line"] == 7 and by["B", 9]["unquoted_inline_comment"] == "# why"
    assert by["C", 10]["value"] == "#no" and by["D", 11]["value"] == "" and by["D", 11]["unquoted_inline_comment"] == "#yes"
    assert not by["E", 12]["has_value"] and by["F", 14]["value"] == "a#b" and by["F", 14]["has_trailing_whitespace"]
    assert by["G", 15]["value"] == "$X\\n" and by["I", 19]["references"] == ["CC", "DD"]
    assert [(i["kind"], i["line"]) for i in found.issues] == [("unknown", 16), ("no-separator", 17)]
    assert [(n["code"], n["line"], n["column"]) for n in found.notes] == [("trailing-garbage", 15, 10)]


def test_dotenv_without_an_end():
    found = dotenv.parse("e", "A=\"open\nB=1\n" + "x" * 3000 + "\n")
    assert [(d["name"], d["has_value"]) for d in found.decls] == [("A", True)]
    assert found.issues[0]["kind"] == "unterminated-quote" and found.notes[0]["code"] == "line-too-long"
    assert dotenv.parse("e", "A=\"\"").decls[0]["has_value"] and dotenv.parse("e", "A=\x01").notes[0]["code"] == "control-characters"


@pytest.mark.parametrize(
    ("path", "want"),
    [
        (".env", ("dev", True, False)), (".env.example", ("example", False, False)), (".env.local", ("local", False, True)),
        (".env.test", ("test", True, True)), (".env.production", ("production", True, False)), ("a/.env.template", ("template", False, False)),
        ("prod.env", ("production", True, False)), (".env.staging", ("test", True, True)), (".env.production.local", ("local", False, True)),
        ("env.dist", ("example", False, False)),
    ],
)
def test_classify(path, want):
    assert dotenv.classify(path) == want


def test_dockerfile():
    text = "FROM n:${TAG:-1} AS b\nARG X=1\nARG --flag Y\nENV A=1 B=\"c d\" \\\n    C=$X\nENV OLD some ${A} \\$NO $$NO $(cmd)\nCOPY --from=$STAGE a $B\n# $N\n"
    found = [(r["name"], r["line"], r["column"], r["kind"], r["required"]) for r in dockerfile.scan("Dockerfile", text)]
    assert found == [
        ("TAG", 1, 10, "dockerfile-usage", False), ("X", 2, 5, "dockerfile-arg", False), ("Y", 3, 12, "dockerfile-arg", True),
        ("A", 4, 5, "dockerfile-env", False), ("B", 4, 9, "dockerfile-env", False), ("C", 4, 5, "dockerfile-env", False),
        ("X", 4, 8, "dockerfile-usage", False), ("OLD", 6, 5, "dockerfile-env", False), ("A", 6, 16, "dockerfile-usage", False),
        ("B", 7, 23, "dockerfile-usage", False),
    ]
    assert dockerfile.is_dockerfile("a/Dockerfile.dev") and dockerfile.is_dockerfile("web.dockerfile") and not dockerfile.is_dockerfile("Dockerfiles")


def test_compose():
    text = (
        "x-a: 1\nservices:\n  web:\n    environment:\n      A: 1 # c\n      B:\n      \"C\": ''\n    env_file: .env, 'b.env'\n"
        "    build:\n      args:\n        - K=1\n        - L\n  db:\n    environment:\n      - M=1\n      - N\n    env_file:\n      - .env\n"
        "      - path: c.env\n        required: false\n    image: $IMG${R:?m}$$N ${O:-${P}}\n  x-skip:\n    environment:\n      Q: 1\n  web:\n    environment:\n      Z: 1\n"
    )
    found = [(r["name"], r["line"], r["column"], r["kind"].removeprefix("compose-"), r["required"]) for r in compose.scan("docker-compose.yml", text)]
    assert found == [
        ("A", 5, 7, "environment", False), ("B", 6, 7, "environment", True), ("C", 7, 7, "environment", True), (".env", 8, 15, "env-file", True),
        ("b.env", 8, 21, "env-file", True), ("K", 11, 11, "build-arg", False), ("L", 12, 11, "build-arg", True), ("M", 15, 9, "environment", False),
        ("N", 16, 9, "environment", True), (".env", 18, 9, "env-file", True), ("c.env", 19, 15, "env-file", True), ("IMG", 21, 12, "interpolation", False),
        ("R", 21, 16, "interpolation", True), ("O", 21, 27, "interpolation", False),
    ]
    assert compose.is_compose("a/compose.override.yaml") and compose.is_compose("docker-compose.yml") and not compose.is_compose("decompose.yml")


def test_ci():
    github = "env:\n  A: 1\n  'B': ''\njobs:\n  j:\n    steps:\n    - run: echo ${{ secrets.TOK }} ${{ vars.V }} # x\n      env:\n        C: ${{ env.A }}\n    - name: n\n"
    found = [(r["name"], r["line"], r["column"], r["kind"], r["required"]) for r in ci.scan(".github/workflows/ci.yml", github)]
    assert found == [
        ("A", 2, 3, "ci-env", False), ("B", 3, 4, "ci-env", True), ("TOK", 7, 29, "ci-secret", True), ("V", 7, 45, "ci-var", False),
        ("C", 9, 9, "ci-env", False), ("A", 9, 20, "ci-env-usage", False),
    ]
    gitlab = "variables:\n  A: $B\njob:\n  script:\n  - echo $C ${D:-x}\n  other: $NO\n"
    assert [(r["name"], r["line"], r["kind"]) for r in ci.scan(".gitlab-ci.yml", gitlab)] == [
        ("A", 2, "ci-env"), ("B", 2, "ci-env-usage"), ("C", 5, "ci-env-usage"), ("D", 5, "ci-env-usage")]
    azure = "variables:\n  A: 1\nenv:\n  E: 2\nsteps:\n- script: echo $(A) ${{ variables.B }}\n"
    assert [r["name"] for r in ci.scan("azure-pipelines.yml", azure)] == ["A", "E", "A", "B"]
    circle = "jobs:\n  b:\n    environment:\n      A: x$B\n"
    assert [(r["name"], r["kind"]) for r in ci.scan(".circleci/config.yml", circle)] == [("A", "ci-env"), ("B", "ci-env-usage")]
    assert ci.dialect(".github/workflows/docker-compose.yml") is None and ci.dialect("ci.yml") is None


def test_markers_and_ignore():
    text = "a # envlattice-disable-line unused-variable, empty-value\n# ENVLATTICE-disable-next-line x\n// envlattice-disable-file y"
    assert markers.parse(text) == [(1, "unused-variable"), (1, "empty-value"), (3, "x"), (None, "y")]
    rules = ignore.Ignore(["# c", "*.log", "!keep.log", "/top", "dir/", "a/**/z", "[ab].x", r"\!odd", "deep/*.t"])
    yes = ["x.log", "p/x.log", "top", "dir/any", "a/z", "a/b/c/z", "p/a.x", "!odd", "deep/q.t"]
    no = ["keep.log", "p/top", "c.x", "p/deep/q.t", "deep/r/q.t"]
    assert all(rules.ignored(p, False) for p in yes) and not any(rules.ignored(p, False) for p in no)
    assert rules.ignored("dir", True) and not rules.ignored("dir", False)


def test_markers_in_spark(spark):
    text = "a # envlattice-disable-line unused-variable, empty-value\n# ENVLATTICE-disable-next-line x\n// envlattice-disable-file y"
    files = spark.createDataFrame([("f", text), ("g", "plain"), ("h", None)], "path string, text string")
    found = {(r.file, r.line, r.rule_id) for r in markers.markers(files).collect()}
    assert found == {("f", a, b) for a, b in markers.parse(text)}


def test_references():
    assert braced("${A} ${B:-x} ${C ${D?} ${E:?} ${1} ${F-${G}}") == [(0, 4, "A"), (5, 12, "B"), (17, 22, "D"), (23, 29, "E"), (35, 43, "F")]
    assert interpolations("${A:-${B}} x$C $D $$E $(F) ${{G}} ${H:?e}") == [(0, "A", False), (15, "D", False), (34, "H", True)]


def test_tree(tmp_path):
    for name, body in {".env": b"A=1", "a.py": b"x", "b.png": b"x", "gradlew": b"x", "bin/x.py": b"x", "big.js": b"x" * 70_000, "nul.js": b"\0", "sub/.gitignore": b"out.js\nskip/\n",
                       "sub/skip/c.js": b"x", "sub/out.js": b"x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    (tmp_path / "link").symlink_to(tmp_path / "a.py")
    found, _ = tree.plan(str(tmp_path), tree.Config())
    assert [f[0] for f in found.files] == [".env", "a.py", "sub/.gitignore", "sub/out.js"]
    assert found.skipped == [("b.png", "extension"), ("big.js", "too-large"), ("gradlew", "generated"), ("link", "symlink"), ("nul.js", "binary"), ("sub/skip", "gitignore")]
    assert tree.class_of("x/.env.local", tree.Config()) == "env" and tree.language_of("A.TSX") == "typescript"


HARD = ["${A-" * 25_000, "{" * 100_000, "'" * 100_000, "`${" * 30_000, "/*" * 50_000, "\\" * 100_000, "\"\\" * 50_000, "$" * 100_000, " " * 100_000 + "x", "a:" * 50_000, "export " * 15_000]


@pytest.mark.parametrize("i", range(len(HARD)))
def test_odd_texts_take_little_time(i):
    began = time.time()
    for language in tree.LANGUAGES:
        accessors.scan("f", HARD[i], language)
    for read in (dockerfile.scan, compose.scan):
        read("f", HARD[i])
        read("f", "ENV A=" + HARD[i])
    for path in (".github/workflows/a.yml", ".gitlab-ci.yml", "azure-pipelines.yml", ".circleci/config.yml"):
        ci.scan(path, HARD[i])
    dotenv.parse("f", HARD[i])
    dotenv.parse("f", "A=" + HARD[i])
    assert time.time() - began < 12


def test_many_reads_in_a_file():
    text = "".join(f"const a{i} = process.env.NAME_{i};\n" for i in range(50_000))
    began = time.time()
    assert len(accessors.scan("f.ts", text, "typescript")) == 50_000
    assert time.time() - began < 6


@pytest.mark.parametrize(
    ("read", "line"),
    [
        (lambda t: compose.scan("compose.yml", t), lambda n: "a: " + " ".join(f"${{V{i}:-x}}" for i in range(n))),
        (lambda t: dockerfile.scan("Dockerfile", t), lambda n: "RUN " + " ".join(f"${{V{i}}} $W{i}" for i in range(n // 2))),
        (lambda t: dockerfile.scan("Dockerfile", t), lambda n: "RUN " + " \\\n".join(f"$W{i}" for i in range(n))),
        (lambda t: ci.scan(".gitlab-ci.yml", t), lambda n: "a:\n  script:\n  - é🙂 " + " ".join(f"$W{i}" for i in range(n))),
        (lambda t: dotenv.parse(".env", t).decls, lambda n: "\n".join(f"V{i % 5}=🙂${i}" for i in range(n))),
        (lambda t: accessors.scan("f", t, "shell"), lambda n: " ".join(f"$WW{i}" for i in range(n))),
    ],
)
def test_eight_times_the_input_takes_no_more_than_fifteen_times_the_time(read, line):
    def took(n):
        text, best = line(n), 1e9
        for _ in range(2):
            began = time.perf_counter()
            assert len(read(text)) == n
            best = min(best, time.perf_counter() - began)
        return best

    assert took(64_000) <= 15 * took(8_000) + 0.25


def test_positions_of_wide_letters():
    assert [r["column"] for r in dockerfile.scan("Dockerfile", "RUN 🙂 $A \\\n  é $B")] == [9, 6]
    assert [r["column"] for r in compose.scan("compose.yml", "a: 🙂 ${B}")] == [7]


def test_a_task_gives_out_bounded_batches_file_by_file(spark, monkeypatch):
    import pyarrow as pa

    from envlattice import schemas
    from envlattice.sources import accessors, project

    class Files:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    n = 2 * project.ROWS + 5
    text = "\n".join(f"os.getenv('KEY_{i}')" for i in range(n))
    read = []

    def rows(path, language, kind, text):
        read.append(path)
        return accessors.scan(path, text, language)

    files = pa.RecordBatch.from_pydict({"path": ["a", "b"], "language": ["python"] * 2, "class": ["code"] * 2, "text": [text, "os.getenv('LAST')"]})
    out = project._mapped(Files(), schemas.USAGES, rows)(iter([files]))
    first = next(out)
    assert first.num_rows == project.ROWS and read == ["a"]  # before the next file is read
    rest = [b.num_rows for b in out]
    assert max(rest) <= project.ROWS and sum(rest) + first.num_rows == n + 1


def test_the_queries_of_languages_gather_keys_once(spark, tmp_path):
    from envlattice.plans import languages

    spark.createDataFrame([(i, i % 7) for i in range(40)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    language, shapes = languages.LANGUAGES["src26_typescript"]
    orders = spark.read.parquet(f"{tmp_path}/orders.parquet")
    made = languages.files(orders, language, shapes)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # shapes are made of what was gathered, not gathered
    texts = {r.path: r.text for r in made.collect()}
    assert len(texts) == 7 * len(shapes)
    assert texts["typescript/s8/f3"] == shapes[8].header + "\n".join(["x(env.KEY_3);"] * 6)


def test_ci_files_in_pieces_are_read_as_whole():
    import random

    from envlattice.sources import ci

    rng = random.Random(5)
    forms = ["variables:", "env:", "KEY: $(REF)", "K: ''", "- name: A", "- variables:", "- # c", "# KEY: $(NO)", "", "script: echo $A", "- x",
             "environment:", "---", "steps:", "- - K: ${B}", "\tT: 1", "\ufeffV: 2"]
    for path in ("azure-pipelines.yml", ".github/workflows/a.yml", ".gitlab-ci.yml", ".circleci/config.yml"):
        some = 0
        for _ in range(1000):
            lines = [" " * rng.choice([0, 0, 1, 2, 2, 4, 6]) + rng.choice(forms) for _ in range(rng.randrange(2, 30))]
            want = ci.scan(path, "\n".join(lines))
            got, above, at = [], [], 0
            while at < len(lines):
                n = rng.randrange(1, 8)
                got += ci.scan(path, "\n".join(lines[at : at + n]), at + 1, above)
                above = ci.open_lines([*above, *ci.open_lines(lines[at : at + n])])
                at += n
            assert got == want, (path, lines)
            some += len(want)
        assert some > 300


def test_azure_query_reads_one_file_in_pieces(spark, tmp_path, monkeypatch):
    import duckdb

    from envlattice.plans import texts

    spark.createDataFrame([(i * 3, i % 11) for i in range(500)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(texts, "PIECE", 100)
    assert texts.AZURE.pieces(spark, str(tmp_path)).count() == 15
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = duckdb.sql(texts.ORACLES["src37_azure"]).fetchall()
    assert sorted(map(tuple, texts.QUERIES["src37_azure"](spark, str(tmp_path)).collect())) == sorted(want)


def test_a_file_of_code_is_sent_in_pieces_and_read_whole(spark, monkeypatch):
    import pyarrow as pa

    from envlattice import schemas
    from envlattice.plans import languages
    from envlattice.sources import accessors, project

    language, shapes = languages.LANGUAGES["src26_typescript"]
    orders = spark.createDataFrame([(i, i % 100) for i in range(100 * 2 * languages.PIECE + 100)], "o_orderkey long, o_custkey long")
    parts = languages.files(orders.where("o_custkey = 3"), language, shapes).collect()
    assert max(r.text.count("\n") for r in parts) <= languages.PIECE + 1  # a header's line more
    texts = {}
    for r in parts:
        assert not texts.get(r.path, ("", False))[1]  # nothing follows a last piece
        texts[r.path] = (texts.get(r.path, ("", False))[0] + r.text, r.last)
    assert texts == {f"typescript/s{i}/f3": (s.header + "\n".join([s.line.replace("@", "").replace("KEY", "KEY_3")] * (2 * languages.PIECE + 1)), True)
                     for i, s in enumerate(shapes)}

    class Files:
        def select(self, *columns):
            assert columns == ("path", "language", "class", "text", "last")
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    pieces = [("a", "os.getenv('A')\nos.get", False), ("a", "env('B')", True), ("b", "os.getenv('C')", True)]
    batches = [pa.RecordBatch.from_pydict({"path": [p], "language": ["python"], "class": ["code"], "text": [t], "last": [x]}) for p, t, x in pieces]
    run = project._mapped(Files(), schemas.USAGES, lambda path, own, kind, text: accessors.scan(path, text, own), pieces=True)
    rows = [r for b in run(iter(batches)) for r in b.to_pylist()]
    assert [(r["name"], r["file"], r["line"]) for r in rows] == [("A", "a", 1), ("B", "a", 2), ("C", "b", 1)]
