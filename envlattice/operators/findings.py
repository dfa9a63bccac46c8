"""All rules together: severities, suppression, duplicates, order and summary."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envlattice.config import Config
from envlattice.functions import lists, text
from envlattice.operators import catalogue, contract, hygiene, security
from envlattice.operators.finding import RowRule, run_together
from envlattice.operators.relations import Relations, example_paths, ignored, judged

Rule = Callable[[Relations, Config], DataFrame]

#: Every rule by id, in order of registration.
RULES: dict[str, Rule] = {
    i: getattr(module, i.replace("-", "_"))
    for module, ids in ((contract, catalogue.IDS[:10]), (hygiene, catalogue.IDS[10:18]), (security, catalogue.IDS[18:]))
    for i in ids
}
def rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, catalogue.SEVERITIES)), severity)


def by_order() -> list[Column]:
    """The order of findings: severity, place, rule, message, variable."""
    return [
        rank(F.col("severity")).desc(), F.col("file"), F.col("line"), F.col("column"), F.col("rule_id"), F.col("message"),
        F.coalesce("variable", F.lit("")),
    ]


def raw_findings(rel: Relations, config: Config, rules: dict[str, Rule] | None = None) -> DataFrame:
    """What all rules give out; those that the configuration ignores do not run.

    All built-in rules run together: see ``together``. ``rules`` adds or replaces rules by id; any function of relations
    and configuration to FINDING_INPUT rows will do.
    """
    own = {i: r for i, r in (rules or {}).items() if i not in config.ignore_rules}
    wanted = [i for i in RULES if i not in config.ignore_rules and i not in own]
    parts = [*together(rel, config, wanted), *(r(rel, config) for r in own.values())]
    return reduce(DataFrame.unionByName, parts)


def name_facts(rel: Relations, decls: DataFrame, config: Config) -> DataFrame:
    """What the rules ask of a name, one row a name: each relation is summed up on its own before they meet."""
    place, value = F.struct("file", "line", "column"), F.struct("file", "line", "column", "value")
    real, sample = ~F.col("example"), hygiene.is_sample()
    mine = decls.groupBy("name").agg(
        F.lit(True).alias("declared"),
        F.bool_or("example").alias("documented"),
        F.bool_or(real).alias("in_real_file"),
        F.every("dev_only_any").alias("only_dev"),
        F.array_sort(F.collect_set("file")).alias("files"),
        F.min(place).alias("first_place"),
        F.min(F.when(F.col("example"), place)).alias("first_example"),
        F.min(F.when(~sample, value)).alias("first"),
        (F.min(F.when(~sample, F.col("value"))) != F.max(F.when(~sample, F.col("value")))).alias("two_values"),
        (F.min(F.when(~sample, F.col("file"))) != F.max(F.when(~sample, F.col("file")))).alias("two_files"),
    )
    kind = F.col("kind")
    refs = rel.infra.groupBy("name").agg(
        F.lit(True).alias("referenced"),
        F.bool_or(kind.isin(lists.DECLARING_KINDS)).alias("declared_by_infra"),
        F.bool_or(kind == "ci-secret").alias("in_ci_secrets"),
        F.bool_or(kind == "compose-environment").alias("in_environment"),
    )
    reads = rel.usages.groupBy("name").agg(F.lit(True).alias("read"))
    out = mine.join(reads, "name", "full").join(refs, "name", "full")
    flags = [c for c, t in out.dtypes if t == "boolean"]
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})


def together(rel: Relations, config: Config, wanted: list[str]) -> list[DataFrame]:
    """The findings of many rules at the cost of few passes.

    Declarations, reads and references are each joined once with the facts of their name, numbered within name and
    file, and exploded to the findings that apply to a row: three shuffles for what the rules alone need over twenty for.
    """
    decls = judged(rel, config)
    facts = name_facts(rel, decls, config)
    examples = example_paths(rel, decls, config)
    example = examples.agg(F.min("path").alias("example_path"))  # always one row, perhaps of null
    on = ~ignored(config)
    unused = ~F.col("read") & ~F.col("referenced")
    first = F.col("n") == 1
    place = F.struct("file", "line", "column")

    def numbered(df: DataFrame, **classes: Column) -> DataFrame:
        """``n``: the place of a row among those of its name and file, and the same within each class."""
        rest = [c for c in df.columns if c not in ("name", "file", "line", "column")]
        order = ["line", "column", *rest]
        base = Window.partitionBy("name", "file")
        df = df.withColumn("n", F.row_number().over(base.orderBy(*order)))
        for c, value in classes.items():
            df = df.withColumn(f"__{c}", value)
            df = df.withColumn(c, F.row_number().over(Window.partitionBy("name", "file", f"__{c}").orderBy(*order)))
        return df

    prefix, unmet = contract.unmet_prefix(rel)
    rows = numbered(decls, n_example=F.col("example"), n_sample=hygiene.is_sample()).join(facts, "name")
    rows = hygiene.examined(security.inspected(rows, F.col("value"), F.col("name"), config), config)
    rows = rows.withColumns({"prefix": prefix, "unmet": unmet}).crossJoin(F.broadcast(example))
    real = ~F.col("example") & (F.col("n_example") == 1)
    later = F.struct("file", "line", "column", "value") > F.col("first")
    expands = F.col("shared") & (F.size("references") > 0) & ~hygiene.is_local()
    conflict = ~hygiene.is_sample() & F.col("two_values") & F.col("two_files") & later
    of_decls = [
        RowRule("missing-from-example", on & real & ~F.col("documented") & F.col("example_path").isNotNull(), contract.missing_from_example_columns()),
        RowRule("unused-variable", on & unused & (place == F.col("first_place")), contract.unused_variable_columns()),
        RowRule("example-out-of-sync", on & unused & ~F.col("in_real_file") & (place == F.col("first_example")), contract.example_out_of_sync_columns()),
        RowRule("framework-prefix-mismatch", on & first & F.col("unmet").isNotNull(), contract.framework_prefix_mismatch_columns()),
        RowRule("conflicting-values", on & conflict, hygiene.conflicting_values_columns(config)),
        RowRule("expansion-unsupported", on & ~hygiene.is_sample() & (F.col("n_sample") == 1) & expands, hygiene.expansion_unsupported_columns()),
        RowRule("invalid-name", on & first & security.is_invalid(), security.invalid_name_columns()),
        RowRule("reserved-name", on & first & security.listed(config.reserved_names), security.reserved_name_columns()),
        RowRule("hostile-name", on & first & security.listed(config.hostile_names), security.hostile_declared_columns()),
        RowRule("shell-incompatible-name", on & first & security.is_too_long(), security.shell_incompatible_name_columns()),
        *hygiene.row_rules(config),
        *security.row_rules(config),
    ]
    reads = numbered(rel.usages, n_required=F.col("required")).join(facts, "name")
    undeclared = on & first & ~F.col("declared")
    ambient = F.col("name").isin(lists.AMBIENT_NAMES)
    of_reads = [
        RowRule("missing-in-env", undeclared & ~ambient & ~F.col("declared_by_infra"), contract.missing_in_env_columns()),
        RowRule(
            "prod-crash", on & F.col("required") & (F.col("n_required") == 1) & F.col("declared") & F.col("only_dev") & ~F.col("in_ci_secrets"),
            contract.prod_crash_columns(),
        ),
        RowRule("invalid-name", undeclared & security.is_invalid(), security.invalid_name_columns()),
        RowRule("hostile-name", undeclared & security.listed(config.hostile_names), security.hostile_read_columns()),
    ]
    refs = rel.infra.join(facts, "name")
    secret = (F.col("kind") == "ci-secret") & text.is_secretish(F.col("name"), config.secret_name_pattern) & ~F.col("documented")
    loose = (F.col("kind") == "compose-interpolation") & ~F.col("declared") & ~F.col("in_environment")
    of_refs = [
        RowRule("ci-secret-undeclared", on & secret, contract.ci_secret_undeclared_columns()),
        RowRule("compose-var-undeclared", on & loose, contract.compose_var_undeclared_columns()),
    ]
    parts = []
    for df, some in ((rows, of_decls), (reads, of_reads), (refs, of_refs), (None, contract.file_rules())):
        some = [r for r in some if r.rule in wanted]
        if some:
            parts.append(run_together(contract.file_references(rel, config) if df is None else df, some))
    if "example-out-of-sync" in wanted and config.require_example_file:
        parts.append(contract.no_example_file(decls, examples))
    parts += [RULES[i](rel, config) for i in ("unterminated-quote", "secret-fallback-literal") if i in wanted]
    return parts or [RULES["unterminated-quote"](rel, config).limit(0)]


def resolve(raw: DataFrame, rel: Relations, config: Config, extra: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Findings: with title, severity and link, without the suppressed, and once each.

    A finding's own severity comes before the configuration's, and that before the rule's. Suppressions are by file and
    line, or by whole file. Of findings of one rule, place and variable the first in order of message stays.
    """
    table = [(r[0], r[3], r[1], n) for n, r in enumerate(catalogue.RULES)]
    table += [(i, title, severity, len(catalogue.RULES) + n) for n, (i, title, severity) in enumerate(extra or [])]
    dim = raw.sparkSession.createDataFrame(table, "rule_id string, rule_title string, default string, rule_order int")
    configured = F.lit(None).cast("string")
    for rule, severity in config.severities.items():
        configured = F.when(F.col("rule_id") == rule, severity).otherwise(configured)
    found = raw.join(F.broadcast(dim), "rule_id", "left")  # one row a rule
    found = found.withColumns(
        {
            "severity": F.coalesce("severity", configured, "default", F.lit("warn")),
            "rule_title": F.coalesce("rule_title", "rule_id"),
            "docs_url": F.concat(F.lit(f"{catalogue.DOCS}#"), "rule_id"),
        }
    )
    if config.ignore_rules:
        found = found.where(~F.col("rule_id").isin(sorted(config.ignore_rules)))
    if rel.suppressions is not None:
        lines = rel.suppressions.where("line is not null").select("file", "line", "rule_id").distinct()
        files = rel.suppressions.where("line is null").select("file", "rule_id").distinct()
        found = found.join(lines, ["file", "line", "rule_id"], "left_anti").join(files, ["file", "rule_id"], "left_anti")
    keys = ["rule_id", "file", "line", "column", F.coalesce("variable", F.lit(""))]
    once = Window.partitionBy(*keys).orderBy("message", "severity", F.coalesce("fingerprint", F.lit("")))
    found = found.withColumn("__n", F.row_number().over(once)).where("__n = 1")
    return found.select(
        "rule_id", "rule_title", "severity", "message", "file", "line", "column", "docs_url", "variable", "hint", "fingerprint"
    )


def findings(rel: Relations, config: Config | None = None) -> DataFrame:
    """All findings in order."""
    config = config or Config()
    return resolve(raw_findings(rel, config), rel, config).orderBy(*by_order())


def at_or_above(found: DataFrame, severity: str) -> DataFrame:
    return found.where(rank(F.col("severity")) >= catalogue.SEVERITIES.index(severity) + 1)


def summarise(found: DataFrame, rel: Relations, config: Config, files_scanned: int = 0, diagnostics: int = 0) -> DataFrame:
    """One row: counts by severity and rule, and of variables and files."""
    count = lambda s: F.count(F.when(F.col("severity") == s, 1))
    by_rule = found.groupBy("rule_id").count().agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "count")))).alias("by_rule")
    )
    totals = found.agg(
        count("error").alias("error"), count("warn").alias("warn"), count("info").alias("info"), F.count("*").alias("total"),
        F.count_distinct("file").alias("files_with_findings"), F.count_distinct("rule_id").alias("rules_fired"),
    )
    known = rel.decls.select("name", F.lit(True).alias("d")).unionAll(rel.usages.select("name", F.lit(False))).groupBy("name")
    known = known.agg(F.bool_or("d").alias("declared"), F.bool_or(~F.col("d")).alias("read"))
    variables = known.agg(
        F.count("*").alias("variables"), F.count_if("declared").alias("declared"), F.count_if("read").alias("read"),
        F.count_if(text.is_secretish(F.col("name"), config.secret_name_pattern)).alias("secretish"),
    )
    # three results of one row each
    return totals.crossJoin(variables).crossJoin(by_rule).withColumns(
        {"files_scanned": F.lit(files_scanned), "diagnostics": F.lit(diagnostics)}
    )


def in_file_order() -> list[Column]:
    return [F.col("line"), F.col("column"), F.col("rule_id"), F.coalesce("variable", F.lit(""))]


def capped(found: DataFrame, limit: int = 20) -> DataFrame:
    """The first ``limit`` findings of every file, with ``hidden``, how many more it has: the feature is the cap."""
    placed = found.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(*in_file_order()))).where(F.col("n") <= limit)
    hidden = found.groupBy("file").agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("hidden"))
    return placed.join(hidden, "file").drop("n")


def worst(found: DataFrame) -> DataFrame:
    """(rule_id, n, worst) of every rule that fired: its findings, and the highest severity among them."""
    highest = F.max(F.struct(rank(F.col("severity")), "severity"))["severity"]
    return found.groupBy("rule_id").agg(F.count("*").alias("n"), highest.alias("worst"))


def placed(found: DataFrame, *order: Column) -> DataFrame:
    """``found`` with ``position``, from 0 on in an order: numbered by file, and the files' totals summed up before that.

    The order starts with the file, so no task has more than one file's findings, and one task a row for each file.
    """
    totals = found.groupBy("file").agg(F.count("*").alias("in_file"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("file").orderBy(*(order or in_file_order())))
    return found.withColumn("inside", inside).join(starts, "file").withColumn("position", F.col("start") + F.col("inside") - 1).drop("start", "inside")
