"""Every accessor of every language, over files whose lines are made from orders; SQL knows each read's place and mode.

A shape is one line of code with ``KEY`` where the name is and ``@`` in front of the column that is reported. Each order gives a
line of one of 50 files for every shape of the language, so all accessors see all orders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envlattice import schemas
from envlattice.sources import accessors
from envlattice.sources.project import _mapped


@dataclass(frozen=True)
class Shape:
    line: str
    accessor: str
    fallback: bool = False
    required: bool = False
    literal: str | None = None
    header: str = ""
    via_import: bool = False

    @property
    def parts(self) -> tuple[str, str]:
        before, after = self.line.replace("@", "").split("KEY")
        return before, after

    @property
    def column(self) -> int:
        return self.line.index("@") + 1


_KIT = "import { env } from '$env/dynamic/private';\n"
_SWIFT = "ProcessInfo.processInfo.environment"
#: By query: the language of the reader, and its shapes.
LANGUAGES: dict[str, tuple[str, list[Shape]]] = {
    "src26_typescript": ("typescript", [
        Shape("globalThis.process?.env?.@KEY ?? 'x';", "process.env", True, False, "x"),
        Shape("use(process.env[@'KEY'] || \"y\");", "process.env", True, False, "y"),
        Shape("const { @KEY = 'd' } = process.env;", "process.env", True, False, "d"),
        Shape("const { @'KEY': a } = process.env;", "process.env"),
        Shape("x(import.meta.env.@KEY);", "import.meta.env"),
        Shape("x(Bun.env.@KEY);", "Bun.env"),
        Shape("x(Deno.env.get(@'KEY', 'z'));", "Deno.env.get", True, False, "z"),
        Shape("import { @KEY } from '$env/static/public';", "$env/static/public", False, True, via_import=True),
        Shape("x(env.@KEY);", "$env/dynamic/private", header=_KIT, via_import=True),
        Shape("x(env[@'KEY']);", "$env/dynamic/private", header=_KIT, via_import=True),
    ]),
    "src26_python_forms": ("python", [
        Shape("os.environ.setdefault(@'KEY', 'x')", "os.environ", True, False, "x"),
        Shape("x = os . getenv( @\"KEY\" )", "os.getenv"),
        Shape("environ[@'KEY']", "os.environ", False, True, header="from os import environ\n"),
        Shape("e.get(@'KEY', 'q')", "os.environ", True, False, "q", header="from os import environ as e\n"),
        Shape("    @KEY: str = 'x'", "BaseSettings", True, False, "x", header="class S(BaseSettings):\n"),
        Shape("    @KEY: int", "BaseSettings", False, True, header="class S(BaseSettings):\n"),
    ]),
    "src26_go": ("go", [
        Shape('a := os.Getenv(@"KEY")', "os.Getenv"),
        Shape("a := Getenv(@`KEY`)", "os.Getenv", header='import "os"\n'),
        Shape('a, ok := os.LookupEnv(@"KEY")', "os.LookupEnv", True),
    ]),
    "src26_rust": ("rust", [
        Shape('std::env::var(@"KEY").expect("x");', "env::var", False, True),
        Shape('env::var(@"KEY").unwrap_or("x".into());', "env::var", True, False, "x"),
        Shape('var(@"KEY").ok();', "env::var", True, False, header="use std::env::var;\n"),
    ]),
    "src26_java": ("java", [
        Shape('System.getenv(@"KEY");', "System.getenv"),
        Shape('System.getenv().get(@"KEY");', "System.getenv"),
        Shape('System.getProperty(@"KEY", "x");', "System.getProperty", True, False, "x"),
    ]),
    "src26_kotlin": ("kotlin", [Shape('val a = System.getenv(@"KEY")', "System.getenv")]),
    "src26_csharp": ("csharp", [
        Shape('Environment.GetEnvironmentVariable(@"KEY");', "Environment.GetEnvironmentVariable"),
        Shape('builder.Configuration[@"KEY"];', "IConfiguration"),
        Shape('config.GetConnectionString(@"KEY");', "GetConnectionString", False, True),
    ]),
    "src26_ruby": ("ruby", [
        Shape("a = ENV[@'KEY']", "ENV", False, True),
        Shape("a = ENV[@'KEY'] || 'x'", "ENV", True, True, "x"),
        Shape("a = ENV.fetch(@'KEY') { 'x' }", "ENV.fetch", True, True, "x"),
    ]),
    "src26_php": ("php", [
        Shape("$a = getenv(@'KEY');", "getenv"),
        Shape("$a = $_ENV[@'KEY'];", "$_ENV"),
        Shape("$a = $_SERVER[@'KEY'];", "$_SERVER"),
        Shape("$a = env(@'KEY', 'x');", "env", True, False, "x"),
    ]),
    "src26_perl": ("perl", [
        Shape("my $a = $ENV{@KEY} // 'x';", "%ENV", True, False, "x"),
        Shape("my $a = $ENV{@'KEY'};", "%ENV"),
    ]),
    "src26_shell": ("shell", [
        Shape('echo "$@KEY"', "shell-parameter"),
        Shape("echo ${@KEY}", "shell-parameter"),
        Shape("echo ${@KEY:-x}", "shell-parameter", True, False, "x"),
        Shape("echo ${@KEY:?needed}", "shell-parameter", False, True),
        Shape("printenv @KEY", "printenv", False, True),
    ]),
    "src26_batch": ("batch", [
        Shape("echo %@KEY%", "batch-parameter"),
        Shape("if not defined @KEY exit", "batch-parameter"),
    ]),
    "src26_swift": ("swift", [
        Shape(f'let a = {_SWIFT}[@"KEY"]', _SWIFT),
        Shape('let a = environment[@"KEY"]', _SWIFT, header="import Foundation\n"),
    ]),
    "src26_dart": ("dart", [
        Shape("var a = Platform.environment[@'KEY'];", "Platform.environment"),
        Shape("var a = String.fromEnvironment(@'KEY', 'x');", "String.fromEnvironment", True, False, "x"),
    ]),
    "src26_elixir": ("elixir", [
        Shape('System.get_env(@"KEY")', "System.get_env"),
        Shape('System.fetch_env(@"KEY")', "System.fetch_env"),
        Shape('System.fetch_env!(@"KEY")', "System.fetch_env", False, True),
    ]),
}
#: Files of a shape, and lines of a piece of one: what goes to Python at once is bounded by rows.
FILES, PIECE = 50, 32


def files(orders: DataFrame, language: str, shapes: list[Shape]) -> DataFrame:
    """(path, language, class, text, last) of the files of all shapes, in pieces of whole lines; a file's pieces follow each other.

    Only the orders' keys are gathered by file, once for all shapes; a task then makes one file's pieces at a time.
    """
    keys = orders.select((F.col("o_custkey") % FILES).alias("file"), "o_orderkey", "o_custkey").repartition(FILES, "file")
    each = keys.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_custkey"))).alias("keys"))
    made = F.array(
        *(
            F.struct(F.lit(f"{language}/s{i}/f").alias("folder"), F.lit(shape.header).alias("header"), *map(F.lit, shape.parts))
            for i, shape in enumerate(shapes)
        )
    ).cast("array<struct<folder: string, header: string, before: string, after: string>>")
    each = each.select("file", "keys", F.explode(made).alias("s"))
    line = lambda x: F.concat("s.before", F.lit("KEY_"), x["o_custkey"].cast("string"), "s.after")

    def piece(i):
        lines = F.array_join(F.transform(F.slice("keys", i, PIECE), line), "\n")
        last = i + PIECE > F.size("keys")
        start = F.when(i == 1, F.col("s.header")).otherwise("")
        return F.struct(F.concat(start, lines, F.when(last, "").otherwise("\n")).alias("text"), last.alias("last"))

    cut = F.transform(F.sequence(F.lit(1), F.size("keys"), F.lit(PIECE)), piece)
    return each.select("file", "s.folder", F.explode(cut).alias("p")).select(
        F.concat("folder", F.col("file").cast("string")).alias("path"), F.lit(language).alias("language"),
        F.lit("code").alias("class"), "p.text", "p.last",
    )


def _query(language: str, shapes: list[Shape]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        scan = lambda path, own, kind, text: accessors.scan(path, text, own)
        found = _mapped(files(orders, language, shapes), schemas.USAGES, scan, pieces=True)
        return found.selectExpr(
            "name", "file", "line", "`column` AS col", "accessor", "has_fallback", "required", "via_import", "fallback_literal"
        )

    return run


def _text(value: str | None) -> str:
    return "NULL::VARCHAR" if value is None else "'" + value.replace("'", "''") + "'"


def _oracle(language: str, shapes: list[Shape]) -> str:
    rows = ", ".join(
        f"({i}, {s.header.count(chr(10))}, {s.column}, {_text(s.accessor)}, {s.fallback}, {s.required}, {s.via_import}, {_text(s.literal)})"
        for i, s in enumerate(shapes)
    )
    return f"""SELECT 'KEY_' || o_custkey AS name, '{language}/s' || i || '/f' || (o_custkey % {FILES}) AS file,
  (row_number() OVER (PARTITION BY i, o_custkey % {FILES} ORDER BY o_orderkey) + h)::INT AS line, c::INT AS col, accessor,
  has_fallback, required, via_import, literal AS fallback_literal
FROM orders CROSS JOIN (VALUES {rows}) s(i, h, c, accessor, has_fallback, required, via_import, literal)"""


QUERIES = {name: _query(*of) for name, of in LANGUAGES.items()}
ORACLES = {name: _oracle(*of) for name, of in LANGUAGES.items()}
