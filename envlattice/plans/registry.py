"""All named queries of the library, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from envlattice.plans import inventory, languages, rules, texts

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return rules.QUERIES | inventory.QUERIES | texts.QUERIES | languages.QUERIES


def oracle_sql() -> dict[str, str]:
    return rules.ORACLES | inventory.ORACLES | texts.ORACLES | languages.ORACLES
