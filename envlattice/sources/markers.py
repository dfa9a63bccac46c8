"""Inline markers that suppress findings: of a line, the next line, or a whole file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = "envlattice-disable"
#: Texts above so many letters are not searched beyond four times the file limit.
MAX_BYTES = 2 << 20
_MARKER = rf"(?i){WORD}-(next-line|line|file)[\s:,]*([a-z][a-z0-9-]*(?:[\s,]+[a-z][a-z0-9-]*)*)"


def markers(files: DataFrame) -> DataFrame:
    """(file, line, rule_id) rows of texts (path, text); a null line stands for the whole file. All built-in functions.

    The cheap test for the word comes before the pattern, so texts without a marker are not split.
    """
    lines = files.where(F.lower("text").contains(WORD)).select("path", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    hits = lines.where(F.lower("line").contains(WORD)).select(
        "path", "i", "line", F.posexplode(F.regexp_extract_all("line", F.lit(_MARKER), F.lit(1))).alias("k", "scope")
    )
    ids = F.get(F.regexp_extract_all("line", F.lit(_MARKER), F.lit(2)), F.col("k"))
    each = hits.select("path", "i", F.lower("scope").alias("scope"), F.explode(F.split(ids, r"[\s,]+")).alias("rule_id"))
    line = F.when(F.col("scope") == "line", F.col("i") + 1).when(F.col("scope") == "next-line", F.col("i") + 2)
    out = each.select(F.col("path").alias("file"), line.cast("int").alias("line"), F.regexp_replace("rule_id", r"[.,;]+\z", "").alias("rule_id"))
    return out.where("rule_id <> ''").distinct()


def parse(text: str) -> list[tuple[int | None, str]]:
    """The same of one text in Python: (line or None, rule)."""
    out = []
    for i, line in enumerate(text.split("\n"), 1):
        for m in re.finditer(_MARKER, line, re.A):
            at = {"file": None, "line": i, "next-line": i + 1}[m[1].lower()]
            out += [(at, rule) for rule in re.split(r"[\s,]+", m[2]) if rule]
    return list(dict.fromkeys(out))
