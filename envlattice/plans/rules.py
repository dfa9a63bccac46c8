"""The 28 rules over the projected relations, each beside the SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from envlattice.config import Config
from envlattice.functions import credentials, lists
from envlattice.operators import catalogue, findings
from envlattice.plans import testdata


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _any_pattern(value: str, ids: list[str] | None = None) -> str:
    return "(" + " OR ".join(f"regexp_matches({value}, '{p}')" for i, _, p in credentials.PATTERNS if not ids or i in ids) + ")"


def _entropy(v: str) -> str:
    return (
        f"list_sum(list_transform(list_distinct(string_split({v}, '')), lambda ch: "
        f"-((length({v}) - length(replace({v}, ch, '')))::DOUBLE / length({v})) * "
        f"log2((length({v}) - length(replace({v}, ch, '')))::DOUBLE / length({v}))))"
    )


_SECRETISH = f"regexp_matches(name, '(?i){lists.SECRET_NAME}')"
_PLAIN = "lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g'))"
_DIGEST = "substr(sha256({}), 1, 12)"
_PASSWORD = "nullif(regexp_extract(value, '://[^:]+:([^@]{3,})@', 1), '')"


def _placeholder(v: str) -> str:
    plain = f"lower(regexp_replace({v}, '^\\s+|\\s+$', '', 'g'))"
    password = f"lower(nullif(regexp_extract({v}, '://[^:]+:([^@]{{3,}})@', 1), ''))"
    return (
        f"({plain} = '' OR {plain} IN ({quoted(lists.WEAK_VALUES)}) OR regexp_matches({plain}, '{lists.PLACEHOLDER_VALUE}') "
        f"OR coalesce({password} IN ({quoted(lists.PLACEHOLDER_PASSWORDS)}), false))"
    )


def _detected(v: str) -> str:
    made = f"({_SECRETISH} AND length({v}) >= 20 AND NOT regexp_matches({v}, '\\s') AND {_entropy(v)} >= 3.5 AND NOT {_placeholder(v)})"
    return f"({_any_pattern(v)} OR {made})"


def _out(rule: str, source: str, severity: str = "NULL", variable: str = "name", digest: str = "NULL", where: str = "true") -> str:
    return (
        f"SELECT '{rule}' AS rule_id, {severity}::VARCHAR AS severity, file, line, col, {variable}::VARCHAR AS variable, "
        f"{digest}::VARCHAR AS fingerprint FROM {source} WHERE {where}"
    )


def _first(source: str, keys: str, order: str, where: str = "true") -> str:
    rows = f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {source} WHERE {where}"
    return f"(SELECT * FROM ({rows}) WHERE rn = 1)"


_EXAMPLE = "kind IN ('example', 'template')"
_UNUSED = "name NOT IN (SELECT name FROM usages) AND name NOT IN (SELECT name FROM infra)"
_UNDECLARED = "name NOT IN (SELECT name FROM decls)"
_FIRST_DECL = _first("decls", "file, name", "line, col")
_REFS = f"""(
  SELECT r.*, (SELECT f.path FROM env_files f WHERE f.present AND f.path IN (r.resolved, r.bare)
               ORDER BY f.path = r.resolved DESC LIMIT 1) AS hit
  FROM (SELECT *, CASE WHEN file LIKE 'deploy/%' THEN
                    CASE WHEN target LIKE '../%' THEN substr(target, 4) ELSE 'deploy/' || target END
                  ELSE target END AS resolved,
               CASE WHEN target LIKE '%/%' THEN NULL ELSE target END AS bare
        FROM {_first("(SELECT *, CASE WHEN name LIKE './%' THEN substr(name, 3) ELSE name END AS target FROM infra WHERE refers_to_file)", "file, target", "line, col")}) r)"""
_HIT = f"(SELECT r.*, e.dev_only, e.committed FROM {_REFS} r LEFT JOIN env_files e ON e.path = r.hit)"
_CONFLICTS = """(
  SELECT d.* FROM decls d JOIN (
    SELECT name, min((file, line, col, value)) AS f FROM decls WHERE kind <> 'example' GROUP BY name
    HAVING count(DISTINCT value) > 1 AND count(DISTINCT file) > 1) c USING (name)
  WHERE kind <> 'example' AND (d.file, d.line, d.col, d.value) > c.f)"""
_FIRST_VALUE = """(
  SELECT x.*, c.v AS first_value FROM """ + _CONFLICTS + """ x JOIN (
    SELECT name, arg_min(value, (file, line, col, value)) AS v FROM decls WHERE kind <> 'example' GROUP BY name) c USING (name))"""
_SITES = f"(SELECT name, file, line, col FROM decls UNION ALL SELECT name, file, line, col FROM usages WHERE {_UNDECLARED})"


def _sensitive(v: str) -> str:
    return f"({_SECRETISH} OR (length({v}) >= 8 AND {_any_pattern(v)}))"


_SPECIAL = r"[\s#$''\"\\=]"
SQL = {
    "missing-in-env": _out(
        "missing-in-env", _first("usages", "name, file", "line, col"),
        where=f"name NOT IN ({quoted(lists.AMBIENT_NAMES)}) AND {_UNDECLARED} AND "
        f"name NOT IN (SELECT name FROM infra WHERE kind IN ({quoted(lists.DECLARING_KINDS)}))",
    ),
    "missing-from-example": _out(
        "missing-from-example", _first("decls", "name, file", "line, col", f"NOT {_EXAMPLE}"),
        where=f"name NOT IN (SELECT name FROM decls WHERE {_EXAMPLE})",
    ),
    "unused-variable": _out("unused-variable", _first("decls", "name", "file, line, col", _UNUSED)),
    "prod-crash": _out(
        "prod-crash", _first("usages", "name, file", "line, col", "required"),
        where="name IN (SELECT name FROM decls GROUP BY name HAVING bool_and(dev_only)) AND "
        "name NOT IN (SELECT name FROM infra WHERE kind = 'ci-secret')",
    ),
    "example-out-of-sync": _out(
        "example-out-of-sync", _first("decls", "name", "file, line, col", f"{_EXAMPLE} AND {_UNUSED}"),
        where=f"name NOT IN (SELECT name FROM decls WHERE NOT {_EXAMPLE})",
    ),
    "ci-secret-undeclared": _out(
        "ci-secret-undeclared", "infra",
        where=f"kind = 'ci-secret' AND {_SECRETISH} AND name NOT IN (SELECT name FROM decls WHERE {_EXAMPLE})",
    ),
    "compose-var-undeclared": _out(
        "compose-var-undeclared", "infra", "CASE WHEN required THEN 'error' ELSE 'info' END",
        where=f"kind = 'compose-interpolation' AND {_UNDECLARED} AND "
        "name NOT IN (SELECT name FROM infra WHERE kind = 'compose-environment')",
    ),
    "env-file-missing": _out("env-file-missing", _REFS, variable="NULL", where="hit IS NULL"),
    "env-file-untracked": _out("env-file-untracked", _HIT, variable="NULL", where="dev_only OR NOT committed"),
    "framework-prefix-mismatch": _out("framework-prefix-mismatch", _FIRST_DECL, where="starts_with(name, 'VITE_')"),
    "duplicate-key": _out("duplicate-key", "decls", where="dup IS NOT NULL"),
    "conflicting-values": _out(
        "conflicting-values", _FIRST_VALUE,
        digest=f"CASE WHEN {_sensitive('value')} OR {_sensitive('first_value')} THEN {_DIGEST.format('value')} END",
    ),
    "empty-value": _out("empty-value", "decls", where=f"NOT has_value AND NOT {_EXAMPLE}"),
    "unquoted-special-chars": _out(
        "unquoted-special-chars", "decls", where=f"quoted IS NULL AND regexp_matches(value, '{_SPECIAL}')"
    ),
    "inline-comment-truncation": _out("inline-comment-truncation", "decls", where="comment IS NOT NULL AND has_value"),
    "export-prefix": _out("export-prefix", "decls", where="exported"),
    "unterminated-quote": _out(
        "unterminated-quote", "(SELECT path AS file, 3 AS line, 1 AS col FROM env_files WHERE path = '.env.test')", variable="NULL"
    ),
    "expansion-unsupported": _out(
        "expansion-unsupported", _first("decls", "name, file", "line, col", f"NOT {_EXAMPLE}"),
        where="shared AND ref IS NOT NULL AND NOT dev_only AND NOT ends_with(file, '.local')",
    ),
    "invalid-name": _out(
        "invalid-name", _first(_SITES, "file, name", "line, col"), where="NOT regexp_matches(name, '^[A-Z][A-Z0-9_]*$')"
    ),
    "reserved-name": _out("reserved-name", _FIRST_DECL, where=f"upper(name) IN ({quoted(lists.RESERVED_NAMES)})"),
    "hostile-name": _out(
        "hostile-name", _FIRST_DECL, "CASE WHEN shared OR NOT dev_only THEN 'error' ELSE 'warn' END",
        where=f"upper(name) IN ({quoted(lists.HOSTILE_NAMES)})",
    ) + " UNION ALL " + _out(
        "hostile-name", _first("usages", "file, name", "line, col", _UNDECLARED), "'info'",
        where=f"upper(name) IN ({quoted(lists.HOSTILE_NAMES)})",
    ),
    "shell-incompatible-name": _out(
        "shell-incompatible-name", _FIRST_DECL, where="regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') AND length(name) > 127"
    ),
    "weak-secret": _out(
        "weak-secret", "decls", digest=_DIGEST.format("value"),
        where=f"NOT {_EXAMPLE} AND {_SECRETISH} AND ({_PLAIN} = '' OR {_PLAIN} IN ({quoted(lists.WEAK_VALUES)}) OR "
        f"regexp_matches({_PLAIN}, '{lists.PLACEHOLDER_VALUE}'))",
    ),
    "secret-in-repo": _out(
        "secret-in-repo", "(SELECT d.*, coalesce(e.committed, true) AS committed FROM decls d LEFT JOIN env_files e ON e.path = d.file)",
        "CASE WHEN committed THEN 'error' ELSE 'warn' END", digest=_DIGEST.format("value"),
        where=f"NOT {_EXAMPLE} AND length(value) >= 8 AND {_detected('value')}",
    ),
    "secret-in-example": _out(
        "secret-in-example", "decls", digest=_DIGEST.format("value"),
        where=f"{_EXAMPLE} AND length(value) >= 8 AND NOT {_placeholder('value')} AND {_detected('value')}",
    ),
    "secret-fallback-literal": _out(
        "secret-fallback-literal", "usages", digest=_DIGEST.format("fallback_literal"),
        where=f"fallback_literal <> '' AND {_SECRETISH} AND {_detected('fallback_literal')}",
    ),
    "debug-flag-shared-env": _out(
        "debug-flag-shared-env", "decls",
        where=f"shared AND kind NOT IN ('example', 'template', 'local', 'test') AND upper(name) IN ({quoted(lists.DEBUG_NAMES)}) "
        f"AND {_PLAIN} IN ({quoted(lists.DEBUG_VALUES)})",
    ),
    "hardcoded-connection-string": _out(
        "hardcoded-connection-string", "decls", digest=_DIGEST.format("value"),
        where=f"({_EXAMPLE} OR NOT {_SECRETISH}) AND {_any_pattern('value', credentials.CONNECTION_IDS)} AND "
        f"length({_PASSWORD}) >= 8 AND {_PASSWORD} NOT IN ({quoted(lists.PLACEHOLDER_PASSWORDS)})",
    ),
}
assert list(sorted(SQL)) == sorted(catalogue.IDS)

OUT = ["rule_id", "severity", "file", "line", "`column` AS col", "variable", "fingerprint"]
_ALL = " UNION ALL ".join(f"({q})" for q in SQL.values())
_DEFAULTS = ", ".join(f"('{i}', '{s}')" for i, s, *_ in catalogue.RULES)
FINDINGS_SQL = f"""{testdata.ORACLE}, raw AS ({_ALL}),
resolved AS (SELECT r.* REPLACE (coalesce(r.severity, d.s) AS severity) FROM raw r
             JOIN (VALUES {_DEFAULTS}) d(i, s) ON d.i = r.rule_id),
kept AS (SELECT r.* FROM resolved r
         ANTI JOIN (SELECT * FROM suppressions WHERE line IS NOT NULL) s
           ON s.file = r.file AND s.line = r.line AND s.rule_id = r.rule_id),
open AS (SELECT k.* FROM kept k ANTI JOIN (SELECT * FROM suppressions WHERE line IS NULL) s
           ON s.file = k.file AND s.rule_id = k.rule_id),
findings AS (SELECT * EXCLUDE (n) FROM (
  SELECT *, row_number() OVER (PARTITION BY rule_id, file, line, col, coalesce(variable, '')
                               ORDER BY coalesce(fingerprint, '')) AS n FROM open) WHERE n = 1)
"""


def _rule_query(rule: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return findings.RULES[rule](testdata.relations(spark, sf_dir), Config()).selectExpr(*OUT)

    return run


def query_name(rule: str) -> str:
    return f"r{catalogue.IDS.index(rule) + 1:02d}_{rule.replace('-', '_')}"


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.findings(testdata.relations(spark, sf_dir).cached(), Config())


def findings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_findings(spark, sf_dir).selectExpr(*OUT)


QUERIES = {query_name(r): _rule_query(r) for r in catalogue.IDS} | {"srt01_findings": findings_query}
ORACLES = {query_name(r): f"{testdata.ORACLE}\n{q}" for r, q in SQL.items()} | {
    "srt01_findings": FINDINGS_SQL + "SELECT * FROM findings"
}
