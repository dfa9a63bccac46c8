"""One query for each operator that the rules alone do not show, beside its SQL."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from envlattice.config import Config
from envlattice.functions import globs, lists, text
from envlattice.operators import catalogue, findings, hygiene, relations, rollup
from envlattice.plans import rules, testdata
from envlattice.plans.rules import quoted
from envlattice.sinks import documents, dotenv, report
from envlattice.sources import dotenv as reader
from envlattice.sources import tree

O = testdata.ORACLE  # noqa: E741
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CONFIG = Config()


def query(name: str, sql: str | None):
    """Registers a query (spark, sf_dir) under a name, with its SQL if there is one."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def on_relations(name: str, sql: str | None, prefix: str = O):
    """The same for a function of the projected relations."""

    def add(f):
        query(name, sql and prefix + sql)(lambda spark, sf_dir: f(testdata.relations(spark, sf_dir)))
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _col(df: DataFrame, *columns: str) -> DataFrame:
    return df.selectExpr(*(c.replace("column", "`column` AS col") if c == "column" else c for c in columns))


# Filters and predicates


_PARTS = (
    "SELECT o_orderkey, concat(CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'app/' WHEN 2 THEN 'production/' ELSE 'a/test/' END, "
    "CASE o_custkey % 12 WHEN 0 THEN '.env' WHEN 1 THEN '.env.example' WHEN 2 THEN 'prod.env' WHEN 3 THEN '.env.local' WHEN 4 THEN "
    "'.env.Production.local' WHEN 5 THEN '.env.staging' WHEN 6 THEN 'env.template' WHEN 7 THEN '.env.dist' WHEN 8 THEN '.env.e2e-x' "
    "WHEN 9 THEN 'web_dev.env' WHEN 10 THEN '.env.live.sample' ELSE '.env.unheard' END) AS path FROM "
)


@query(
    "fil01_classify",
    "SELECT o_orderkey, path, kind, kind NOT IN ('local', 'example', 'template') AS shared, kind IN ('local', 'test') AS dev_only FROM "
    "(SELECT *, CASE regexp_extract(path, '[^/]*$') WHEN '.env' THEN 'dev' WHEN '.env.example' THEN 'example' WHEN 'prod.env' THEN 'production' "
    "WHEN '.env.local' THEN 'local' WHEN '.env.Production.local' THEN 'local' WHEN '.env.staging' THEN 'test' WHEN 'env.template' THEN 'template' "
    f"WHEN '.env.dist' THEN 'example' WHEN '.env.e2e-x' THEN 'test' WHEN '.env.live.sample' THEN 'example' ELSE 'dev' END AS kind FROM ({_PARTS} orders))",
)
def _classify(spark, sf_dir):
    """The reader's own classification, a file a row, as the scan asks for it."""
    paths = spark.sql(f"{_PARTS} {{orders}}", orders=table(spark, sf_dir, "orders"))

    def run(batches):
        for batch in batches:
            found = [reader.classify(p) for p in batch.column(1).to_pylist()]
            columns = zip(*found, strict=True) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, map(list, columns))], ["o_orderkey", "path", "kind", "shared", "dev_only"])

    return paths.mapInArrow(run, "o_orderkey long, path string, kind string, shared boolean, dev_only boolean")


@on_relations("fil03_secretish", f"SELECT DISTINCT name, {rules._SECRETISH} AS secretish FROM decls")
def _secretish(rel):
    return rel.decls.select("name", text.is_secretish(F.col("name")).alias("secretish")).distinct()


@on_relations(
    "fil04_ignored_variables",
    "SELECT count(*)::BIGINT AS n FROM decls WHERE NOT regexp_matches(name, '(?i)^var_00[^/][^/]$|^api_.*$')",
)
def _ignored(rel):
    return relations.known(rel.decls, Config(ignore_variables=("var_00??", "API_**"))).agg(F.count("*").alias("n"))


@on_relations(
    "fil07_example_decls",
    "SELECT file, line, kind IN ('example', 'template') AS example, file <> '.env.local' AND file <> 'app/.env.production' AS committed, "
    "dev_only FROM decls",
)
def _judged(rel):
    return relations.judged(rel, CONFIG).select("file", "line", "example", "committed", F.col("dev_only_any").alias("dev_only"))


@on_relations("fil09_hygiene_examples", "SELECT file, line FROM decls WHERE kind IN ('example', 'template') OR file = '.env.example'")
def _samples(rel):
    return rel.decls.where(hygiene.is_sample()).select("file", "line")


@on_relations(
    "fil11_at_or_above", "SELECT count(*)::BIGINT AS n FROM findings WHERE severity IN ('warn', 'error')", rules.FINDINGS_SQL
)
def _above(rel):
    return findings.at_or_above(findings.findings(rel), "warn").agg(F.count("*").alias("n"))


@on_relations(
    "fil12_one_rule", "SELECT rule_id, file, line FROM findings WHERE rule_id = 'export-prefix'", rules.FINDINGS_SQL
)
def _one_rule(rel):
    config = Config(ignore_rules=frozenset(set(catalogue.IDS) - {"export-prefix"}))
    return findings.findings(rel, config).select("rule_id", "file", "line")


@on_relations("fil15_placeholders", f"SELECT file, line, {rules._placeholder('value')} AS placeholder FROM decls")
def _placeholders(rel):
    value = F.col("value")
    return rel.decls.select(
        "file", "line", (text.is_placeholder_value(value, lists.WEAK_VALUES) | text.is_placeholder_url(value)).alias("placeholder")
    )


# Joins


@on_relations(
    "join06_ordered_candidates",
    f", refs AS (SELECT file, target, hit FROM {rules._REFS}) SELECT * FROM refs",
)
def _candidates(rel):
    from envlattice.operators.contract import file_references

    return file_references(rel, CONFIG).select("file", "target", F.col("hit.path").alias("hit"))


@on_relations(
    "join08_prefixes",
    "SELECT DISTINCT name, CASE WHEN starts_with(name, 'REACT_APP_') THEN 'REACT_APP_' WHEN starts_with(name, 'VITE_') THEN 'VITE_' END "
    "AS prefix FROM decls",
)
def _prefixes(rel):
    found = reduce(
        lambda other, p: F.when(F.col("name").startswith(p[0]), p[0]).otherwise(other), reversed(lists.FRAMEWORK_PREFIXES), F.lit(None)
    )
    return rel.decls.select("name", found.cast("string").alias("prefix")).distinct()


@on_relations(
    "join11_pattern_matches",
    "SELECT file, line, " + " || ".join(
        f"CASE WHEN regexp_matches(value, '{p}') THEN '{i};' ELSE '' END" for i, _, p in rules.credentials.PATTERNS
    ) + f" AS ids FROM decls WHERE {rules._any_pattern('value')}",
)
def _matches(rel):
    ids = F.transform(text.credential_matches(F.col("value"), list(CONFIG.secret_patterns)), lambda m: F.concat(m["id"], F.lit(";")))
    return rel.decls.select("file", "line", F.array_join(ids, "").alias("ids")).where("ids <> ''")


@on_relations(
    "join12_suppressed",
    "SELECT rule_id, count(*)::BIGINT AS n FROM resolved GROUP BY rule_id EXCEPT SELECT rule_id, count(*)::BIGINT FROM open GROUP BY rule_id",
    rules.FINDINGS_SQL,
)
def _suppressed(rel):
    raw = findings.raw_findings(rel, CONFIG).select("rule_id", "file", "line")
    lines = rel.suppressions.where("line is not null").distinct()
    files = rel.suppressions.where("line is null").select("file", "rule_id").distinct()
    open_ = raw.join(lines, ["file", "line", "rule_id"], "left_anti").join(files, ["file", "rule_id"], "left_anti")
    n = lambda df: df.groupBy("rule_id").agg(F.count("*").alias("n"))
    return n(raw).subtract(n(open_))


@on_relations(
    "join15_conflicting",
    "SELECT file, line, conflicting FROM (SELECT file, line, count(DISTINCT value) OVER (PARTITION BY name) > 1 AS conflicting FROM decls)",
)
def _conflicting(rel):
    keys = rel.decls.groupBy("name").agg((F.min("value") != F.max("value")).alias("conflicting"))
    return rel.decls.join(keys, "name").select("file", "line", "conflicting")


@on_relations(
    "join16_phantom_files",
    "SELECT DISTINCT resolved AS path FROM (SELECT name, CASE WHEN file LIKE 'deploy/%' THEN CASE WHEN name LIKE '../%' THEN substr(name, 4) "
    "WHEN name LIKE './%' THEN 'deploy/' || substr(name, 3) ELSE 'deploy/' || name END "
    "WHEN name LIKE '%./%' THEN regexp_replace(name, '^[.]+/', '') ELSE name END AS resolved FROM infra WHERE refers_to_file) "
    "WHERE resolved NOT IN (SELECT path FROM env_files) AND "
    "name NOT IN (SELECT regexp_extract(path, '[^/]*$') FROM env_files)",
)
def _phantoms(rel):
    return relations.missing_files(rel.infra, rel.env_files).select("path")


# Aggregations, windows, sets


@on_relations(
    "agg02_summary",
    "SELECT count(*) FILTER (severity = 'error')::BIGINT AS error, count(*) FILTER (severity = 'warn')::BIGINT AS warn, "
    "count(*) FILTER (severity = 'info')::BIGINT AS info, count(*)::BIGINT AS total, count(DISTINCT file)::BIGINT AS files_with_findings, "
    "count(DISTINCT rule_id)::BIGINT AS rules_fired, "
    "(SELECT count(*) FROM (SELECT name FROM decls UNION SELECT name FROM usages))::BIGINT AS variables, "
    "(SELECT count(DISTINCT name) FROM decls)::BIGINT AS declared, (SELECT count(DISTINCT name) FROM usages)::BIGINT AS read, "
    f"(SELECT count(*) FROM (SELECT name FROM decls UNION SELECT name FROM usages) WHERE {rules._SECRETISH})::BIGINT AS secretish "
    "FROM findings",
    rules.FINDINGS_SQL,
)
def _summary(rel):
    found = findings.findings(rel).persist()
    return findings.summarise(found, rel, CONFIG).drop("by_rule", "files_scanned", "diagnostics")


@on_relations("agg02_by_rule", "SELECT rule_id, count(*)::BIGINT AS n FROM findings GROUP BY rule_id", rules.FINDINGS_SQL)
def _by_rule(rel):
    return findings.findings(rel).groupBy("rule_id").agg(F.count("*").alias("n"))


_KEY = f"CASE WHEN {rules._SECRETISH} THEN substr(sha256(value), 1, 12) ELSE CASE WHEN length(value) <= 32 THEN value ELSE substr(value, 1, 31) || '…' END END"
_VARIABLES = f""",
d AS (SELECT name, string_agg(DISTINCT file, ',' ORDER BY file) AS declared_in, bool_or(has_value) AS has_value,
        bool_or(NOT {rules._EXAMPLE} AND {rules._PLAIN} IN ({quoted(lists.WEAK_VALUES)})) AS has_weak_value,
        arg_min(trim(above), (file, line, col)) FILTER (above IS NOT NULL) AS description,
        arg_min(kind, (CASE WHEN {rules._EXAMPLE} THEN 0 WHEN shared THEN 1 ELSE 2 END, file, line, col)) AS kind,
        count(*)::BIGINT AS n_values, count(DISTINCT {_KEY}) > 1 AS conflicting
      FROM decls GROUP BY name),
u AS (SELECT name, bool_or(required) AS required, count(*)::BIGINT AS n_reads, min(file) AS first_read FROM usages GROUP BY name),
i AS (SELECT name, string_agg(DISTINCT kind, ',' ORDER BY kind) AS infra_kinds, string_agg(DISTINCT file, ',' ORDER BY file) AS referenced_in,
        count(*) FILTER (kind IN ('ci-secret', 'ci-var', 'ci-env')) > 0 AS in_ci FROM infra GROUP BY name)
SELECT name, coalesce(declared_in, '') AS declared_in, coalesce(has_value, false) AS has_value, coalesce(has_weak_value, false) AS has_weak_value,
  description, kind, coalesce(n_values, 0) AS n_values, coalesce(conflicting, false) AS conflicting, coalesce(required, false) AS required,
  coalesce(n_reads, 0) AS n_reads, first_read, coalesce(infra_kinds, '') AS infra_kinds, coalesce(referenced_in, '') AS referenced_in,
  coalesce(in_ci, false) AS in_ci, {rules._SECRETISH} AS secretish
FROM d FULL JOIN u USING (name) FULL JOIN i USING (name)"""


@on_relations("agg03_variables", _VARIABLES)
def _variables(rel):
    v = rollup.variables(rel, CONFIG, include_undeclared=True)
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    return v.select(
        "name", F.array_join("declared_in", ",").alias("declared_in"), "has_value", "has_weak_value", "description", "kind",
        size("values").alias("n_values"), F.coalesce(F.get("values", 0)["conflicting"], F.lit(False)).alias("conflicting"), "required",
        size("read_in").alias("n_reads"), F.get("read_in", 0)["file"].alias("first_read"),
        F.array_join("infra_kinds", ",").alias("infra_kinds"), F.array_join("referenced_in", ",").alias("referenced_in"),
        (F.size("ci_names") > 0).alias("in_ci"), "secretish",
    )


@on_relations(
    "agg07_groups",
    "SELECT key, count(*)::BIGINT AS n, min(position)::BIGINT AS first, max(position)::BIGINT AS last FROM (SELECT file AS key, "
    "row_number() OVER (ORDER BY file, line, col, rule_id, coalesce(variable, '')) - 1 AS position FROM findings) GROUP BY key",
    rules.FINDINGS_SQL,
)
def _groups(rel):
    grouped = report.grouped(findings.placed(findings.findings(rel)), "file")
    ends = [F.element_at("findings", i).cast("long").alias(n) for i, n in ((1, "first"), (-1, "last"))]
    return grouped.select("key", F.col("count").alias("n"), *ends)


@on_relations(
    "agg08_rule_severity",
    "SELECT rule_id, count(*)::BIGINT AS n, arg_max(severity, CASE severity WHEN 'error' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END) "
    "AS worst FROM findings GROUP BY rule_id",
    rules.FINDINGS_SQL,
)
def _worst(rel):
    return findings.worst(findings.findings(rel))


@query("agg15_rules_by_severity", f"SELECT s AS severity, count(*)::BIGINT AS n FROM (VALUES {rules._DEFAULTS}) d(i, s) GROUP BY s")
def _rules_by_severity(spark, sf_dir):
    return catalogue.rules(spark).groupBy("severity").agg(F.count("*").alias("n"))


@on_relations("win01_earlier_assignment", "SELECT file, line, name, dup AS duplicate_of_line FROM decls")
def _duplicates(rel):
    return rel.decls.select("file", "line", "name", "duplicate_of_line")


@on_relations("win02_first_in_file", f"SELECT name, file, line FROM {rules._first('decls', 'name, file', 'line, col')}")
def _first_decls(rel):
    return relations.first_per(rel.decls, ["name", "file"], ["line", "column"]).select("name", "file", "line")


@on_relations("win03_first_read", f"SELECT name, file, line, col FROM {rules._first('usages', 'name, file', 'line, col')}")
def _first_reads(rel):
    return _col(relations.first_per(rel.usages, ["name", "file"], ["line", "column"]), "name", "file", "line", "column")


@on_relations("win05_first_of_name", f"SELECT name, file, line FROM {rules._first('decls', 'name', 'file, line, col')}")
def _first_of_name(rel):
    return relations.first_per(rel.decls, ["name"], ["file", "line", "column"]).select("name", "file", "line")


@on_relations(
    "win10_capped",
    "SELECT file, rule_id, line, hidden FROM (SELECT file, rule_id, line, "
    "row_number() OVER (PARTITION BY file ORDER BY line, col, rule_id, coalesce(variable, '')) AS n, "
    "greatest(count(*) OVER (PARTITION BY file) - 20, 0)::BIGINT AS hidden FROM findings) WHERE n <= 20",
    rules.FINDINGS_SQL,
)
def _capped(rel):
    return findings.capped(findings.findings(rel), 20).select("file", "rule_id", "line", "hidden")


@on_relations("set01_names", "SELECT name FROM decls UNION SELECT name FROM usages UNION SELECT name FROM infra")
def _names(rel):
    return relations.names(rel)


@on_relations("set03_undeclared_reads", "SELECT DISTINCT name FROM usages WHERE name NOT IN (SELECT name FROM decls)")
def _undeclared(rel):
    return rel.usages.join(rel.decls.select("name").distinct(), "name", "left_anti").select("name").distinct()


# Scalar functions


@query("scl01_fingerprint", "SELECT doc_id, substr(sha256(text), 1, 12) AS fingerprint FROM documents")
def _fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))


_FLAT = "regexp_replace(text, '\\r?\\n', '\\\\n', 'g')"


@query(
    "scl02_preview",
    f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND text <> '' THEN '<redacted>' WHEN length({_FLAT}) <= 48 THEN {_FLAT} "
    f"ELSE substr({_FLAT}, 1, 47) || '…' END AS preview FROM documents",
)
def _preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text"), F.col("doc_id") % 7 == 0).alias("preview"))


@query(
    "scl03_mask",
    "SELECT doc_id, CASE WHEN length(source) = 0 THEN '<empty>' WHEN length(source) <= 8 THEN repeat('*', length(source)) "
    "ELSE '***' || right(source, 2) END AS short, CASE WHEN length(text) = 0 THEN '<empty>' WHEN length(text) <= 8 THEN "
    "repeat('*', length(text)) ELSE '***' || right(text, 2) END AS long FROM documents",
)
def _mask(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.mask(F.col("source")).alias("short"), text.mask(F.col("text")).alias("long"))


@query(
    "scl06_resolve_path",
    "SELECT page_id, array_to_string(list_reduce(list_concat([['x'][:0]], list_transform(list_concat(['a', 'b'], "
    "string_split(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '([0-9])', '../\\1', 'g'), '/')), lambda s: [s])), "
    "lambda acc, s: CASE WHEN s[1] IN ('', '.') THEN acc WHEN s[1] = '..' THEN acc[:-2] ELSE list_concat(acc, s) END), '/') AS path FROM pages",
)
def _resolve(spark, sf_dir):
    path = F.regexp_replace(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "([0-9])", "../$1")
    return table(spark, sf_dir, "pages").select("page_id", text.resolve_path(F.lit("a/b"), path).alias("path"))


@query(
    "scl07_places",
    "SELECT doc_id, (length(before) - length(replace(before, chr(10), '')) + 1)::BIGINT AS line, "
    "(length(before) - length(regexp_replace(before, '[^\\n]*$', '')) + 1)::BIGINT AS col, "
    "CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines FROM (SELECT doc_id, text, "
    "substr(text, 1, (length(text) // 2)::BIGINT) AS before FROM documents)",
)
def _places(spark, sf_dir):
    body = F.col("text")
    half = F.floor(F.length(body) / 2).cast("int")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.line_of(body, half).cast("long").alias("line"), text.column_of(body, half).cast("long").alias("col"),
        text.count_lines(body).cast("long").alias("n_lines"),
    )


@query(
    "scl09_names",
    "SELECT doc_id, count(*)::BIGINT AS words, count(*) FILTER (regexp_matches(word, '^[A-Za-z_][A-Za-z0-9_]*$'))::BIGINT AS names, "
    "count(*) FILTER (regexp_matches(word, '^[A-Z][A-Z0-9_]*$'))::BIGINT AS upper "
    "FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\n]+')) AS word FROM documents) GROUP BY doc_id",
)
def _name_tests(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0))).alias("word"))
    return words.groupBy("doc_id").agg(
        F.count("*").alias("words"), F.count_if(text.is_env_name(F.col("word"))).alias("names"), F.count_if(text.is_upper_snake(F.col("word"))).alias("upper")
    )


@on_relations(
    "scl11_upper_snake",
    "SELECT DISTINCT name, regexp_replace(upper(regexp_replace(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), "
    "'([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9_]', '_', 'g')), '^_+', '') AS suggestion FROM decls",
)
def _upper_snake(rel):
    return rel.decls.select("name", text.upper_snake(F.col("name")).alias("suggestion")).distinct()


@on_relations("scl13_url_password", f"SELECT file, line, {rules._PASSWORD} AS password FROM decls")
def _password(rel):
    return rel.decls.select("file", "line", text.url_password(F.col("value")).alias("password"))


_CLASSES = [("whitespace", r"\s"), ("#", "#"), ("$", r"\$"), ("''", "''"), ('"', '"'), ("\\", r"\\"), ("=", "="), ("a line break", r"[\r\n]")]


@on_relations(
    "scl14_special_classes",
    "SELECT file, line, " + " || ".join(f"CASE WHEN regexp_matches(value, '{p}') THEN '{n};' ELSE '' END" for n, p in _CLASSES)
    + " AS classes FROM decls",
)
def _classes(rel):
    found = F.transform(text.special_classes(F.col("value")), lambda c: F.concat(c, F.lit(";")))
    return rel.decls.select("file", "line", F.array_join(found, "").alias("classes"))


@on_relations("agg14_entropy", f"SELECT file, line, CASE WHEN value = '' THEN 0.0 ELSE round({rules._entropy('value')}, 6) + 0.0 END AS bits FROM decls")
def _entropy(rel):
    return rel.decls.select("file", "line", F.round(text.entropy(F.col("value")), 6).alias("bits"))


@on_relations(
    "scl17_quoting",
    "SELECT file, line, value = '' OR NOT regexp_matches(value, '^[A-Za-z0-9_./:@+%,~?!=^-]+$') AS quoted, "
    "CASE WHEN value = '' OR NOT regexp_matches(value, '^[A-Za-z0-9_./:@+%,~?!=^-]+$') THEN '\"' || value || '\"' ELSE value END AS normal FROM decls",
)
def _quoting(rel):
    return rel.decls.select("file", "line", dotenv.needs_quoting(F.col("value")).alias("quoted"), dotenv.normalized(F.col("value")).alias("normal"))


_CELL = "replace(replace(regexp_replace(text, '\\r?\\n', ' ', 'g'), '|', '\\|'), '`', '\\`')"


@query(
    "scl18_markdown_cell",
    f"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '—' WHEN length({_CELL}) <= 60 THEN {_CELL} ELSE substr({_CELL}, 1, 59) || '…' END "
    "AS cell FROM documents",
)
def _cell(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.markdown_cell(F.col("text")).alias("cell"))


@query(
    "fingerprinted_literals",
    "SELECT source, count(*)::BIGINT AS n, count(DISTINCT substr(sha256(t), 1, 12))::BIGINT AS digests FROM (SELECT source, "
    "unnest(regexp_extract_all(text, 'token = \"([0-9a-f]{40})\"', 1)) AS t FROM documents) GROUP BY source",
)
def _tokens(spark, sf_dir):
    literals = F.explode(F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{40})"'), F.lit(1)))
    found = table(spark, sf_dir, "documents").select("source", literals.alias("t"))
    return found.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct(text.fingerprint(F.col("t"))).alias("digests"))


@query(
    "scl05_line_texts",
    "SELECT doc_id, n, regexp_replace(string_split(text, chr(10))[n], '\\r$', '') AS line FROM (SELECT doc_id, text, unnest(range(1, 1 + "
    "CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END))::BIGINT AS n FROM documents)",
)
def _line_texts(spark, sf_dir):
    """Every line of every text, without a carriage return at its end."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.greatest(text.count_lines(F.col("text")), F.lit(1)))).alias("n"))
    lines = lines.where("text <> ''")
    return lines.select("doc_id", F.col("n").cast("long").alias("n"), text.line_text(F.col("text"), F.col("n")).alias("line"))


@query(
    "scl08_globs",
    "SELECT doc_id, regexp_matches(source, '(^|/)s[^/]*$') AS deep, length(source) = 4 AND source[2:3] = 'rc' AS one, "
    "source IN ('crawl', 'src1') AS either FROM documents",
)
def _globs(spark, sf_dir):
    source = F.col("source")
    return table(spark, sf_dir, "documents").select(
        "doc_id", source.rlike(globs.glob_regex("**/s*")).alias("deep"), source.rlike(globs.glob_regex("?rc?")).alias("one"),
        source.rlike(globs.glob_regex("{crawl,src1}")).alias("either"),
    )


# Sinks


@on_relations(
    "scl12_name_defects",
    "SELECT DISTINCT name, CASE WHEN regexp_matches(name, '^[0-9]') THEN 'it starts with the digit ' || name[1] WHEN contains(name, '.') "
    "THEN 'it contains . (U+002E)' END AS defect FROM decls",
)
def _defects(rel):
    return rel.decls.select("name", text.name_defect(F.col("name")).alias("defect")).distinct()


@query(
    "srt06_rule_listing",
    "SELECT id AS rule_id, s AS severity, row_number() OVER (ORDER BY CASE s WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, id)::BIGINT "
    f"AS place FROM (VALUES {rules._DEFAULTS}) d(id, s)",
)
def _listing(spark, sf_dir):
    """All rules as the command lists them: by severity, then id. One small table."""
    order = Window.orderBy(findings.rank(F.col("severity")).desc(), "rule_id")
    return catalogue.rules(spark).select("rule_id", "severity", F.row_number().over(order).cast("long").alias("place"))


@on_relations(
    "fil14_rollup_filters",
    "SELECT 'declared' AS kept, count(DISTINCT name)::BIGINT AS n FROM decls UNION ALL "
    "SELECT 'used', count(DISTINCT name)::BIGINT FROM decls WHERE name IN (SELECT name FROM usages) UNION ALL "
    "SELECT 'all', count(*)::BIGINT FROM (SELECT name FROM decls UNION SELECT name FROM usages UNION SELECT name FROM infra)",
)
def _filters(rel):
    kinds = {"declared": (False, True), "used": (False, False), "all": (True, True)}
    counts = [
        rollup.variables(rel, CONFIG, include_undeclared=a, include_unused=b).agg(F.lit(kind).alias("kept"), F.count("*").alias("n"))
        for kind, (a, b) in kinds.items()
    ]
    return reduce(DataFrame.unionAll, counts)


_BARE = "value <> '' AND regexp_matches(value, '^[A-Za-z0-9_./:@+%,~?!=^-]+$')"


@on_relations(
    "snk07_serialized",
    "SELECT file, string_agg(t, chr(10) ORDER BY line, col) || chr(10) AS text FROM (SELECT file, line, col, "
    "CASE WHEN above IS NOT NULL THEN '# ' || above || chr(10) ELSE '' END || CASE WHEN exported THEN 'export ' ELSE '' END || name || '=' || "
    f"CASE WHEN value = '' THEN '' WHEN {_BARE} THEN value ELSE '\"' || value || '\"' END || coalesce(' ' || comment, '') AS t, "
    "row_number() OVER (PARTITION BY file, name ORDER BY line DESC, col DESC) AS n FROM decls) WHERE n = 1 GROUP BY file",
)
def _serialized(rel):
    return dotenv.serialize(rel.decls, style="auto", dedupe="keep-last")


_JSON = "'\"' || replace(replace({}, '\\', '\\\\'), '\"', '\\\"') || '\"'"


def _key(name: str, column: str) -> str:
    return f"coalesce(',\"{name}\":' || {_JSON.format(column)}, '')"


@on_relations(
    "snk03_json_lines",
    "SELECT file, line, '{\"column\":' || col || " + _key("file", "file") + " || " + _key("fingerprint", "fingerprint") + " || ',\"line\":' || line || "
    + _key("ruleId", "rule_id") + " || " + _key("severity", "severity") + " || " + _key("variable", "variable") + " || '}' AS json FROM findings",
    rules.FINDINGS_SQL,
)
def _json_lines(rel):
    return documents.json_lines(findings.findings(rel).select(*_SHOWN))


@on_relations(
    "snk04_sarif_lines",
    "SELECT file, line, '{\"level\":\"' || CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'note' END || "
    "'\",\"locations\":[{\"physicalLocation\":{\"artifactLocation\":{\"uri\":\"' || file || '\",\"uriBaseId\":\"PROJECTROOT\"},\"region\":{\"startColumn\":' || col "
    "|| ',\"startLine\":' || greatest(1, line) || '}}}],\"partialFingerprints\":{\"envlattice/v1\":\"' || concat_ws(':', rule_id, file, greatest(1, line), col) || '\"},\"properties\":{' || "
    "ltrim(" + _key("fingerprint", "fingerprint") + " || " + _key("variable", "variable") + ", ',') || '},\"ruleId\":\"' || rule_id || '\"}' AS json FROM findings",
    rules.FINDINGS_SQL,
)
def _sarif_lines(rel):
    return documents.sarif_lines(findings.findings(rel).select(*_SHOWN))


_SHOWN = ["column", "file", "fingerprint", "line", "rule_id", "severity", "variable"]


_TREE = """
WITH n AS (SELECT n_nationkey AS k, 'r' || n_regionkey || '/' AS r, n_nationkey % 12 AS form FROM nation),
made AS (
  SELECT r || CASE form WHEN 0 THEN 'n' || k || '.env' WHEN 1 THEN 'n' || k || '.py' WHEN 2 THEN 'n' || k || '.png' WHEN 4 THEN 'n' || k || '.txt'
           WHEN 5 THEN 'n' || k || '.go' WHEN 6 THEN 'skip' || k WHEN 7 THEN 'w' || k || '/gradlew' WHEN 8 THEN 'Dockerfile.n' || k
           WHEN 9 THEN 'l' || k || '.js' WHEN 10 THEN 'n' || k || '/compose.yml' ELSE 'own' || k END AS path,
         CASE form WHEN 0 THEN 'env' WHEN 1 THEN 'code' WHEN 2 THEN 'extension' WHEN 4 THEN 'too-large' WHEN 5 THEN 'binary'
           WHEN 6 THEN 'gitignore' WHEN 7 THEN 'generated' WHEN 8 THEN 'dockerfile' WHEN 9 THEN 'symlink' WHEN 10 THEN 'compose'
           ELSE 'gitignore' END AS fate, CASE WHEN form IN (0, 1, 8, 10) THEN length('A=' || k) END AS bytes, form FROM n WHERE form <> 3)
SELECT path, fate, CASE form WHEN 1 THEN 'python' WHEN 0 THEN 'unknown' WHEN 8 THEN 'unknown' WHEN 10 THEN 'unknown' END AS language, bytes::BIGINT AS bytes
FROM made
UNION ALL SELECT '.gitignore', 'other', 'unknown', 7::BIGINT
UNION ALL SELECT DISTINCT 'r' || n_regionkey || '/.gitignore', 'other', 'unknown', 10::BIGINT FROM nation
"""


@query("src01_tree", _TREE)
def _tree(spark, sf_dir):
    """A small project, a file or folder for each nation, walked with its ignore files and read by the data source."""
    nations = [(r["n_nationkey"], r["n_regionkey"]) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()]
    root = made_tree(spark, nations)
    found, _ = tree.plan(root, CONFIG)
    read = tree.read_tree(spark, found, CONFIG).select("path", F.col("class").alias("fate"), "language", F.octet_length("text").cast("long").alias("bytes"))
    left_out = spark.createDataFrame(found.skipped, "path string, fate string")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("language", "string"), ("bytes", "long"))]
    return read.unionAll(left_out.select("path", "fate", *nothing))


def made_tree(spark: SparkSession, nations: list[tuple[int, int]]) -> str:
    """The project's folder, where all machines see it: below spark.checkpoint.dir, or a temporary one in local runs."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="envlattice-tree-", dir=shared and shared.removeprefix("file://"))
    atexit.register(shutil.rmtree, root, ignore_errors=True)

    def put(path: str, body: str) -> None:
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w", newline="") as f:
            f.write(body)

    put(".gitignore", "skip*/\n")
    for k, region in nations:
        r, form, body = f"r{region}", k % 12, f"A={k}"
        put(f"{r}/.gitignore", "/own[0-9]*")
        paths = [f"n{k}.env", f"n{k}.py", f"n{k}.png", f"node_modules/n{k}.js", f"n{k}.txt", f"n{k}.go", f"skip{k}/a.py", f"w{k}/gradlew",
                 f"Dockerfile.n{k}", f"l{k}.js", f"n{k}/compose.yml", f"own{k}/a.py"]
        if form == 9:
            os.makedirs(f"{root}/{r}", exist_ok=True)
            os.symlink(f"{root}/.gitignore", f"{root}/{r}/{paths[9]}")
        else:
            put(f"{r}/{paths[form]}", {4: "x" * 70_000, 5: "\0" * 9}.get(form, body))
    return root
