"""The readers over files whose every line is made by a formula, so that SQL knows what they must find.

Each order is a line of one of 50 files. ``k`` and ``v`` are a key's number and a value; ``line`` counts within the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from envlattice import schemas
from envlattice.sinks.dotenv import format_text
from envlattice.sources import accessors, ci, compose, dockerfile, dotenv, markers
from envlattice.sources.project import _mapped, dotenv_paths

LINES = """
SELECT CONCAT('{folder}f', CAST(o_custkey % 50 AS STRING), '{suffix}') AS path, o_orderkey AS ord, o_orderkey % 6 AS form,
       CAST(o_custkey AS STRING) AS k, CAST(o_orderkey % 97 AS STRING) AS v
FROM {{orders}}"""


#: Order keys of a piece, which bound its lines as each order gives one; partitions in which pieces are made and read.
PIECE, PARTS = 1 << 15, 64


def _case(forms: list[str]) -> str:
    return "CASE form " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"


def c(*parts: str) -> str:
    """SQL that joins literals and columns; a part that starts with a dot is a column."""
    return "CONCAT(" + ", ".join(p[1:] if p.startswith(".") else "'" + p.replace("'", "''") + "'" for p in parts) + ")"


class Made:
    """A kind of file: where it stands, what its lines are, and the rows that they must give."""

    def __init__(self, folder: str, suffix: str, header: str, forms: list[str], language: str, kind: str, one_file: bool = False):
        self.lines = LINES.format(folder=folder, suffix=suffix)
        if one_file:
            self.lines = self.lines.replace(f"CONCAT('{folder}f', CAST(o_custkey % 50 AS STRING), '{suffix}')", f"'{folder}{suffix}'")
        self.header, self.forms, self.language, self.kind = header, forms, language, kind

    def files(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        line = spark.sql(self.lines, orders=orders).selectExpr("path", "ord", f"{_case(self.forms)} AS line")
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
        return line.groupBy("path").agg(F.concat(F.lit(self.header), body).alias("text")).select(
            "path", F.lit(self.language).alias("language"), F.lit(self.kind).alias("class"), "text"
        )

    def pieces(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """(path, language, class, text, piece, first) of the files' pieces of whole lines; ``first`` is a piece's first line."""
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        line = spark.sql(self.lines, orders=orders).selectExpr("path", f"ord DIV {PIECE} AS piece", "ord", f"{_case(self.forms)} AS line")
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
        each = line.repartition(PARTS, "path", "piece").groupBy("path", "piece").agg(body.alias("body"))
        before = Window.partitionBy("path").orderBy("piece")
        count = line.groupBy("path", "piece").agg(F.count("*").alias("n")).select(
            "path", "piece", (F.sum("n").over(before) - F.col("n") + 1).alias("first")
        )
        header = F.when(F.col("first") == 1, F.lit(self.header)).otherwise(F.lit(""))
        start = F.when(F.col("first") == 1, F.col("first")).otherwise(F.col("first") + self.header.count("\n"))
        return each.join(count, ["path", "piece"]).select(
            "path", F.lit(self.language).alias("language"), F.lit(self.kind).alias("class"), F.concat(header, "body").alias("text"),
            "piece", start.cast("int").alias("first"),
        )

    def oracle(self, select: str) -> str:
        lines = self.lines.format(orders="orders")
        first = self.header.count("\n")
        return f"""WITH l AS (SELECT *, (row_number() OVER (PARTITION BY path ORDER BY ord) + {first})::INT AS line,
            {_case(self.forms)} AS t FROM ({lines})) {select}"""


K = "'KEY_' || k"
DOTENV = Made("", ".env", "", [
    c("KEY_", ".k", "=", ".v"), c("export KEY_", ".k", '="', ".v", ' x" # note'), c("# about ", ".k"), c("KEY_", ".k", "="),
    c("KEY_", ".k", "='", ".v", "$A'"), c("KEY_", ".k", "=", ".v", "$", "{REF} # tail"),
], "unknown", "env")
DOTENV_SQL = f"""SELECT {K} AS name, path AS file, line, (CASE form WHEN 1 THEN 8 ELSE 1 END)::INT AS col,
  CASE form WHEN 1 THEN v || ' x' WHEN 3 THEN '' WHEN 4 THEN v || '$A' WHEN 5 THEN v || '${{REF}}' ELSE v END AS value, form <> 3 AS has_value,
  CASE form WHEN 1 THEN '"' WHEN 4 THEN '''' END AS quoted, form = 1 AS exported, CASE form WHEN 4 THEN 'A' WHEN 5 THEN 'REF' ELSE '' END AS refs,
  min(CASE WHEN form <> 2 THEN line END) OVER (PARTITION BY path, k ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS duplicate_of_line,
  CASE form WHEN 1 THEN 'note' END AS inline_comment, CASE form WHEN 5 THEN '# tail' END AS unquoted_inline_comment FROM l"""
JS = Made("src/", ".js", "", [
    c("const a = process.env.KEY_", ".k", ";"), c("const a = process.env.KEY_", ".k", " ?? 'd", ".v", "';"), c("// process.env.KEY_", ".k"),
    c("x(import.meta.env.KEY_", ".k", ", 'process.env.NO');"), c("const { KEY_", ".k", ' = "z" } = process.env;'), c("`${process.env[\"KEY_", ".k", '"]}`'),
], "javascript", "code")
JS_SQL = f"""SELECT {K} AS name, path AS file, line, (CASE form WHEN 3 THEN 19 WHEN 4 THEN 9 WHEN 5 THEN 16 ELSE 23 END)::INT AS col,
  CASE form WHEN 3 THEN 'import.meta.env' ELSE 'process.env' END AS accessor, form IN (1, 4) AS has_fallback, false AS required,
  CASE form WHEN 1 THEN 'd' || v WHEN 4 THEN 'z' END AS fallback_literal FROM l WHERE form <> 2"""
PY = Made("src/", ".py", "import os\n", [
    c("os.environ['KEY_", ".k", "']"), c('a = os.getenv("KEY_', ".k", "\", 'd", ".v", "')"), c("# os.getenv('KEY_", ".k", "')"),
    c("os.environ['KEY_", ".k", "'] = 1"), c("os.environ.get('KEY_", ".k", "')"), c('"""', "os.getenv('KEY_", ".k", "')", '"""'),
], "python", "code")
PY_SQL = f"""SELECT {K} AS name, path AS file, line, (CASE form WHEN 0 THEN 12 WHEN 1 THEN 15 ELSE 16 END)::INT AS col,
  CASE form WHEN 1 THEN 'os.getenv' ELSE 'os.environ' END AS accessor, form = 1 AS has_fallback, form = 0 AS required,
  CASE form WHEN 1 THEN 'd' || v END AS fallback_literal FROM l WHERE form IN (0, 1, 4)"""
DOCKER = Made("", "/Dockerfile", "FROM x\n", [
    c("ENV KEY_", ".k", "=", ".v"), c("ARG KEY_", ".k"), c("# ${KEY_", ".k", "}"), c("RUN echo ${KEY_", ".k", ":-1}"), c("ARG KEY_", ".k", "=", ".v"),
    c("  COPY a $KEY_", ".k"),
], "unknown", "dockerfile")
DOCKER_SQL = f"""SELECT {K} AS name, path AS file, line, (CASE form WHEN 3 THEN 12 WHEN 5 THEN 11 ELSE 5 END)::INT AS col,
  CASE form WHEN 0 THEN 'dockerfile-env' WHEN 3 THEN 'dockerfile-usage' WHEN 5 THEN 'dockerfile-usage' ELSE 'dockerfile-arg' END AS kind,
  form = 1 AS required, form IN (3, 5) AS interpolation FROM l WHERE form <> 2"""
COMPOSE = Made("", "/compose.yml", "services:\n  web:\n    environment:\n", [
    c("      KEY_", ".k", ": ", ".v"), c("      KEY_", ".k", ":"), c("      # KEY_", ".k", ": 1"), c("      KEY_", ".k", ": ${REF_", ".k", ":?no}"),
    c("      - KEY_", ".k", "=", ".v"), c("      - KEY_", ".k", " # c"),
], "unknown", "compose")
COMPOSE_SQL = f"""SELECT {K} AS name, path AS file, line, (CASE WHEN form > 3 THEN 9 ELSE 7 END)::INT AS col, 'compose-environment' AS kind,
  form IN (1, 5) AS required, false AS interpolation FROM l WHERE form <> 2
UNION ALL SELECT 'REF_' || k, path, line, (strpos(t, '$'))::INT, 'compose-interpolation', true, true FROM l WHERE form = 3"""
GITHUB = Made(".github/workflows/", ".yml", "env:\n", [
    c("  KEY_", ".k", ": ", ".v"), c("  KEY_", ".k", ": ${{ secrets.S_", ".k", " }}"), c("  # ${{ secrets.S_", ".k", " }}"), c("  KEY_", ".k", ":"),
    c("  KEY_", ".k", ": ${{ vars.V_", ".k", " }}${{ env.E }}"), c("  KEY_", ".k", ": ''"),
], "unknown", "ci")
GITHUB_SQL = f"""SELECT {K} AS name, path AS file, line, 3 AS col, 'ci-env' AS kind, form IN (3, 5) AS required, false AS interpolation FROM l WHERE form <> 2
UNION ALL SELECT 'S_' || k, path, line, (strpos(t, 'S_'))::INT, 'ci-secret', true, true FROM l WHERE form = 1
UNION ALL SELECT 'V_' || k, path, line, (strpos(t, 'V_'))::INT, 'ci-var', false, true FROM l WHERE form = 4
UNION ALL SELECT 'E', path, line, (strpos(t, 'env.E') + 4)::INT, 'ci-env-usage', false, true FROM l WHERE form = 4"""
#: What GitLab and CircleCI take alike: names with values that a shell expands.
_VALUES = [
    c("  KEY_", ".k", ": ", ".v"), c("  KEY_", ".k", ": $", "REF_", ".k"), c("  # KEY_", ".k", ": $", "REF_", ".k"), c("  KEY_", ".k", ":"),
    c("  KEY_", ".k", ": a$", "{REF_", ".k", "}b"), c("  KEY_", ".k", ": ''"),
]
_VALUES_SQL = f"""SELECT {K} AS name, path AS file, line, 3 AS col, 'ci-env' AS kind, form IN (3, 5) AS required, false AS interpolation FROM l WHERE form <> 2
UNION ALL SELECT 'REF_' || k, path, line, (strpos(t, 'REF_'))::INT, 'ci-env-usage', false, true FROM l WHERE form IN (1, 4)"""
GITLAB = Made(".gitlab/ci/", ".yml", "variables:\n", _VALUES, "unknown", "ci")
CIRCLE = Made("", "/.circleci/config.yml", "environment:\n", _VALUES, "unknown", "ci")
AZURE = Made("", "azure-pipelines.yml", "variables:\n", [
    c("  KEY_", ".k", ": ", ".v"), c("  KEY_", ".k", ": $(REF_", ".k", ")"), c("  # KEY_", ".k", ": $(REF_", ".k", ")"), c("  KEY_", ".k", ":"),
    c("  KEY_", ".k", ": $", "{{ variables.REF_", ".k", " }}"), c("  KEY_", ".k", ": ''"),
], "unknown", "ci", one_file=True)
#: Blanks at line ends, blank lines between runs, and keys in no order.
LOOSE = Made("", ".env", "", [
    c("KEY_", ".k", "=", ".v"), c("KEY_", ".k", "=", ".v", "  "), c("A_", ".k", "=", ".v"), c("M_", ".k", "="), c(""), c("Z_", ".k", "=", ".v"),
], "unknown", "env")
LOOSE_SQL = """, islands AS (SELECT *, sum(CASE WHEN form = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS run FROM l)
SELECT path AS file, row_number() OVER (PARTITION BY path ORDER BY run, regexp_extract(t, '^[^=]+'), line)::BIGINT AS place, rtrim(t) AS text
FROM islands WHERE form <> 4"""
LOADED = Made("src/", ".js", "", [
    c("dotenv.config({ path: '.env.", ".k", "' });"), c("  new Dotenv({ path: \".env.", ".v", "\" });"), c("x();"), c("y('.env.", ".k", "');"),
    c("dotenv.config();"), c("a(); dotenv.config({ path: 'app/.env.", ".k", "' });"),
], "javascript", "code")
LOADED_SQL = """SELECT CASE form WHEN 0 THEN '.env.' || k WHEN 1 THEN '.env.' || v ELSE 'app/.env.' || k END AS name, path AS file, line,
  (CASE form WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 6 END)::INT AS col, 'dotenv-path' AS kind, true AS required, false AS interpolation
FROM l WHERE form IN (0, 1, 5)"""
MARKED = Made("src/", ".go", "", [
    c("x() // envlattice-disable-line rule-", ".k"), c("// Envlattice-Disable-Next-Line rule-", ".k", ", rule-x"), c("// disable-line no"),
    c("// envlattice-disable-file rule-", ".v"), c("y()"), c("# envlattice-disable-line: a-b c-d"),
], "go", "code")
MARKED_SQL = """SELECT DISTINCT * FROM (SELECT path AS file, line, 'rule-' || k AS rule_id FROM l WHERE form = 0
UNION ALL SELECT path, line + 1, 'rule-' || k FROM l WHERE form = 1 UNION ALL SELECT path, line + 1, 'rule-x' FROM l WHERE form = 1
UNION ALL SELECT path, NULL, 'rule-' || v FROM l WHERE form = 3
UNION ALL SELECT path, line, 'a-b' FROM l WHERE form = 5 UNION ALL SELECT path, line, 'c-d' FROM l WHERE form = 5)"""


def _decls(files: DataFrame) -> DataFrame:
    found = _mapped(files, schemas.DECLS, lambda path, language, kind, text: dotenv.parse(path, text).decls)
    return found.selectExpr(
        "name", "file", "line", "`column` AS col", "value", "has_value", "quoted", "exported", "array_join(references, ',') AS refs",
        "duplicate_of_line", "inline_comment", "unquoted_inline_comment",
    )


def _usages(files: DataFrame) -> DataFrame:
    found = _mapped(files, schemas.USAGES, lambda path, language, kind, text: accessors.scan(path, text, language))
    return found.selectExpr("name", "file", "line", "`column` AS col", "accessor", "has_fallback", "required", "fallback_literal")


def _infra(scan):
    def run(files: DataFrame) -> DataFrame:
        found = _mapped(files, schemas.INFRA, lambda path, language, kind, text: scan(path, text))
        return found.selectExpr("name", "file", "line", "`column` AS col", "kind", "required", "interpolation")

    return run


ABOVE = "path string, piece long, above array<string>"


def _ci_pieces(pieces: DataFrame) -> DataFrame:
    """CI files of any length: each piece is read below the lines that are open where it starts.

    A piece's own open lines are few, and those of all pieces of a file are put together in their order.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ci.open_lines(re.split(r"\r\n|\n|\r", text.as_py())) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["path", "piece", "above"])

    def together(table: pa.Table) -> pa.Table:
        table, above, now = table.sort_by("piece"), [], []
        for own in table.column("above").to_pylist():
            above.append(now)
            now = ci.open_lines([*now, *own])
        return table.set_column(2, "above", pa.array(above, pa.list_(pa.string())))

    own = pieces.select("path", "piece", "text").mapInArrow(ends, ABOVE)
    above = own.groupBy("path").applyInArrow(together, ABOVE)
    found = _mapped(
        pieces.join(above, ["path", "piece"]), schemas.INFRA,
        lambda path, language, kind, text, first, above: ci.scan(path, text, first, above), "first", "above",
    )
    return found.selectExpr("name", "file", "line", "`column` AS col", "kind", "required", "interpolation")


FORMATTED = StructType([StructField("file", StringType()), StructField("place", LongType()), StructField("text", StringType())])


def _formatted(files: DataFrame) -> DataFrame:
    """The lines of formatted files that are not blank, numbered."""

    def rows(path: str, language: str, kind: str, text: str) -> list[tuple]:
        lines = [line for line in format_text(text)[0].split("\n") if line]
        return [(path, i, line) for i, line in enumerate(lines, 1)]

    return _mapped(files, FORMATTED, rows)


_READERS = {
    "src18_dotenv": (DOTENV, _decls, DOTENV_SQL),
    "src26_javascript": (JS, _usages, JS_SQL),
    "src26_python": (PY, _usages, PY_SQL),
    "src32_compose": (COMPOSE, _infra(compose.scan), COMPOSE_SQL),
    "src33_dockerfile": (DOCKER, _infra(dockerfile.scan), DOCKER_SQL),
    "src35_github": (GITHUB, _infra(ci.scan), GITHUB_SQL),
    "src41_dotenv_paths": (LOADED, _infra(dotenv_paths), LOADED_SQL),
    "src36_gitlab": (GITLAB, _infra(ci.scan), _VALUES_SQL),
    "src37_azure": (AZURE, _ci_pieces, _VALUES_SQL),
    "src38_circleci": (CIRCLE, _infra(ci.scan), _VALUES_SQL),
    "snk08_formatted": (LOOSE, _formatted, LOOSE_SQL),
    "src43_markers": (MARKED, lambda files: markers.markers(files.select("path", "text")), MARKED_SQL),
}


def _query(made: Made, read):
    if read is _ci_pieces:
        return lambda spark, sf_dir: read(made.pieces(spark, sf_dir))
    return lambda spark, sf_dir: read(made.files(spark, sf_dir))


QUERIES = {name: _query(made, read) for name, (made, read, _) in _READERS.items()}
ORACLES = {name: made.oracle(sql + (" WHERE form <> 2" if name == "src18_dotenv" else "")) for name, (made, _, sql) in _READERS.items()}
