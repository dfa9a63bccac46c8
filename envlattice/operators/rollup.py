"""One row a variable, of all that is known of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envlattice.config import Config
from envlattice.functions import lists, text
from envlattice.operators.relations import SAMPLE_KINDS, Relations

PREVIEW = 32


def description() -> Column:
    """A declaration's leading comments in one line, or null."""
    lines = F.filter(F.transform("leading_comments", text.trimmed), lambda c: c != "")
    joined = text.trimmed(F.regexp_replace(F.array_join(lines, " "), f"{text.BLANK}+", " "))
    return F.when(joined != "", joined)


def decl_facts(decls: DataFrame, config: Config, redact: bool = True) -> DataFrame:
    """By name: files, values with previews, the description, and the best kind (example, shared, first)."""
    secretish = text.is_secretish(F.col("name"), config.secret_name_pattern)
    # what tells two values apart: a digest of secrets, else what a preview shows
    key = F.when(secretish, text.fingerprint(F.col("value"))).otherwise(text.preview(F.col("value"), F.lit(False), PREVIEW))
    sample = F.col("kind").isin(SAMPLE_KINDS)
    weak = ~sample & F.lower(text.trimmed(F.col("value"))).isin(list(config.weak_values))
    shown = text.preview(F.col("value"), secretish | F.lit(redact), PREVIEW)
    place = F.struct("file", "line", "column")
    told = F.when(description().isNotNull(), F.struct("file", "line", "column", description().alias("text")))
    best = F.when(sample, 0).when(F.col("shared"), 1).otherwise(2)
    grouped = decls.withColumns({"__key": key, "__weak": weak}).groupBy("name").agg(
        F.array_sort(F.collect_set("file")).alias("declared_in"),
        F.bool_or("has_value").alias("has_value"),
        F.bool_or("__weak").alias("has_weak_value"),
        F.min(told)["text"].alias("description"),
        F.min_by("kind", F.struct(best, place)).alias("kind"),
        F.array_sort(
            F.collect_list(F.struct("file", "line", "column", shown.alias("preview"), F.col("__key").alias("key"), "shared"))
        ).alias("all"),
        (F.min("__key") != F.max("__key")).alias("__differ"),
    )
    # a value conflicts if any other differs from it: with two keys or more, that is so for each
    values = F.transform(
        "all",
        lambda d: F.struct(d["file"].alias("file"), d["line"].alias("line"), d["preview"].alias("preview"),
                           F.col("__differ").alias("conflicting"), d["shared"].alias("shared")),
    )
    return grouped.withColumn("values", values).drop("all", "__differ")


def usage_facts(usages: DataFrame) -> DataFrame:
    reads = F.array_sort(F.collect_list(F.struct("file", "line", "column", "accessor", "has_fallback", "required")))
    out = usages.groupBy("name").agg(F.bool_or("required").alias("required"), reads.alias("reads"))
    fields = ["file", "line", "accessor", "has_fallback", "required"]
    return out.withColumn("read_in", F.transform("reads", lambda r: F.struct(*(r[f].alias(f) for f in fields)))).drop("reads")


def infra_facts(infra: DataFrame) -> DataFrame:
    in_ci = F.col("kind").isin(lists.CI_KINDS)
    return infra.groupBy("name").agg(
        F.array_sort(F.collect_set("file")).alias("referenced_in"),
        F.array_sort(F.collect_set("kind")).alias("infra_kinds"),
        F.array_sort(F.collect_set(F.when(in_ci, F.col("name")))).alias("ci_names"),
    )


def variables(
    rel: Relations, config: Config | None = None, include_undeclared: bool = False, include_unused: bool = True, redact: bool = True
) -> DataFrame:
    """One row for every name, sorted. Each relation is summed up by name on its own before the three meet."""
    config = config or Config()
    out = decl_facts(rel.decls, config, redact).join(usage_facts(rel.usages), "name", "full").join(infra_facts(rel.infra), "name", "full")
    if not include_undeclared:
        out = out.where("declared_in is not null")
    if not include_unused:
        out = out.where("declared_in is null or read_in is not null")
    kinds = dict(out.dtypes)
    lists_ = ["declared_in", "read_in", "referenced_in", "values", "infra_kinds", "ci_names"]
    flags = ["has_value", "required", "has_weak_value"]
    out = out.withColumns(
        {c: F.coalesce(c, F.array().cast(kinds[c])) for c in lists_} | {c: F.coalesce(c, F.lit(False)) for c in flags}
    )
    secretish = text.is_secretish(F.col("name"), config.secret_name_pattern).alias("secretish")
    return out.select(
        "name", "declared_in", "read_in", "referenced_in", "has_value", "required", secretish, "description", "kind",
        "has_weak_value", "values", "infra_kinds", "ci_names",
    ).orderBy("name")
