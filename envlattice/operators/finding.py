"""What a rule gives out: rows of FINDING_INPUT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envlattice import schemas

COLUMNS = schemas.FINDING_INPUT.fieldNames()


def say(*parts: str | Column) -> Column:
    """A message: strings as they are, columns by their value."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def row(
    rule: str,
    message: Column,
    hint: str | Column,
    severity: Column | str | None = None,
    variable: Column | str | None = "name",
    fingerprint: Column | None = None,
) -> list[Column]:
    """The columns of a finding at a row's file, line and column."""
    null = F.lit(None).cast("string")
    variable = F.col(variable) if isinstance(variable, str) else variable
    return [
        F.lit(rule).alias("rule_id"),
        (F.lit(severity) if isinstance(severity, str) else severity if severity is not None else null).alias("severity"),
        message.alias("message"),
        F.col("file"),
        F.col("line"),
        F.col("column"),
        (variable if variable is not None else null).alias("variable"),
        (F.lit(hint) if isinstance(hint, str) else hint).alias("hint"),
        (fingerprint if fingerprint is not None else null).alias("fingerprint"),
    ]


class RowRule:
    """A rule that needs a declaration's own row only: its condition and its finding.

    Several of them run in one pass: each row is exploded to the findings that apply, so the relation is read once.
    """

    def __init__(self, rule: str, applies: Column, columns: list[Column]):
        self.rule, self.applies, self.columns = rule, applies, columns

    def run(self, decls: DataFrame) -> DataFrame:
        return decls.where(self.applies).select(*self.columns)


def run_together(decls: DataFrame, rules: list[RowRule]) -> DataFrame:
    """The findings of all ``rules`` in one pass."""
    each = F.array_compact(F.array(*(F.when(r.applies, F.struct(*r.columns)) for r in rules)))
    return decls.select(F.explode(each).alias("f")).select(*(F.col(f"f.{c}").alias(c) for c in COLUMNS))
