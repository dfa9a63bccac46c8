"""The hygiene rules: how declarations are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envlattice.config import Config
from envlattice.functions import lists, text
from envlattice.operators.finding import RowRule, row, say
from envlattice.operators.relations import Relations, first_per, ignored, known

PREVIEW, SENSITIVE_LENGTH = 24, 8


def is_sample(kind: str = "kind", file: str = "file") -> Column:
    """Example declarations in the narrower sense of these rules."""
    return F.col(kind).isin("example", "template") | text.base_name(F.col(file)).isin(lists.HYGIENE_EXAMPLES)


def is_sensitive(name: Column, value: Column, config: Config) -> Column:
    """By name, or because the value itself has a credential's shape."""
    shaped = F.size(text.credential_matches(value, list(config.secret_patterns))) > 0
    return text.is_secretish(name, config.secret_name_pattern) | ((text.utf16_length(value) >= SENSITIVE_LENGTH) & shaped)


def hidden() -> Column:
    """The same of a row's own value, where its shapes are known already."""
    return F.col("secretish") | ((text.utf16_length(F.col("value")) >= SENSITIVE_LENGTH) & (F.size("matched") > 0))


def examined(decls: DataFrame, config: Config) -> DataFrame:
    """Declarations with ``classes``, the special letters of a value, and ``shown``, what may be printed of it."""
    name, value = F.col("name"), F.col("value")
    if "matched" not in decls.columns:
        shapes = text.credential_matches(value, list(config.secret_patterns))
        decls = decls.withColumns({"matched": shapes, "secretish": text.is_secretish(name, config.secret_name_pattern)})
    return decls.withColumns({"classes": text.special_classes(value), "shown": text.preview(value, hidden(), PREVIEW)})


def row_rules(config: Config) -> list[RowRule]:
    """The rules that need an examined declaration's row only."""
    name, file = F.col("name"), F.col("file")
    wanted = ~ignored(config)
    classes, shown = F.col("classes"), F.col("shown")
    return [
        RowRule(
            "duplicate-key",
            wanted & F.col("duplicate_of_line").isNotNull(),
            row(
                "duplicate-key",
                say(name, " is declared again; the value of line ", F.col("duplicate_of_line").cast("string"), " of ", file, " is lost"),
                say("remove the assignment of line ", F.col("duplicate_of_line").cast("string")),
            ),
        ),
        RowRule(
            "empty-value",
            wanted & ~F.col("has_value") & ~is_sample(),
            row("empty-value", say(name, " has no value in ", file), "give it a value, or move it to the example file"),
        ),
        RowRule(
            "unquoted-special-chars",
            wanted & F.col("quoted").isNull() & (F.size(classes) > 0),
            row(
                "unquoted-special-chars",
                say(name, " is not quoted in ", file, ", but has ", F.array_join(classes, ", "), " (", shown, ")"),
                "put the value in double quotes",
            ),
        ),
        RowRule(
            "inline-comment-truncation",
            wanted & F.col("unquoted_inline_comment").isNotNull() & F.col("has_value"),
            row(
                "inline-comment-truncation",
                say(name, " has a comment behind an unquoted value in ", file, ", which some loaders keep in the value"),
                "put the comment on a line of its own",
            ),
        ),
        RowRule(
            "export-prefix",
            wanted & F.col("exported"),
            row("export-prefix", say(name, " is exported in ", file, ", which not all loaders accept"), "drop the keyword"),
        ),
    ]


def _row_rule(index: int):
    def run(rel: Relations, config: Config) -> DataFrame:
        return row_rules(config)[index].run(examined(rel.decls, config))

    return run


duplicate_key, empty_value, unquoted_special_chars, inline_comment_truncation, export_prefix = map(_row_rule, range(5))


def conflicting_values(rel: Relations, config: Config) -> DataFrame:
    """Every later real declaration of a name that has two values or more, in two files or more.

    What a name has is summed up once a name and joined back, so that a name of very many declarations is not gathered.
    Rows whose own value equals the first one's are given too.
    """
    decls = known(rel.decls.where(~is_sample()), config)
    place = F.struct("file", "line", "column", "value")
    facts = decls.groupBy("name").agg(
        F.min(place).alias("first"), F.min("value").alias("v0"), F.max("value").alias("v1"), F.min("file").alias("f0"), F.max("file").alias("f1")
    )
    facts = facts.where("v0 <> v1 and f0 <> f1").select("name", "first")
    later = decls.join(facts, "name").where(place > F.col("first"))
    return later.select(*conflicting_values_columns(config))


def conflicting_values_columns(config: Config):
    """Over declarations with ``first``, the place and value of the name's first."""
    name, first = F.col("name"), F.col("first.value")
    secret = is_sensitive(name, first, config) | is_sensitive(name, F.col("value"), config)
    shown = lambda v: text.preview(v, F.lit(False), PREVIEW)
    message = F.when(
        secret, say(name, " has different secret values in ", F.col("first.file"), " and ", F.col("file"))
    ).otherwise(
        say(name, " is ", shown(F.col("value")), " in ", F.col("file"), ", but ", shown(first), " in ", F.col("first.file"))
    )
    digest = F.when(secret, text.fingerprint(F.col("value")))
    return row("conflicting-values", message, "make the values agree, or name files by environment", fingerprint=digest)


def unterminated_quote(rel: Relations, config: Config) -> DataFrame:
    """Parse issues of all kinds, the first of a line. Ignored variables do not matter: a line has no name yet."""
    issues = rel.env_files.select("path", F.posexplode("issues").alias("pos", "issue"))
    issues = issues.select(
        F.col("path").alias("file"), F.col("issue.line").alias("line"), F.col("issue.column").alias("column"),
        F.col("issue.kind").alias("kind"), F.col("issue.message").alias("problem"), "pos",
    )
    first = first_per(issues, ["file", "line"], ["pos"])
    kind = F.when(F.col("kind") == "unterminated-quote", "").otherwise(F.concat("kind", F.lit(": ")))
    message = say(kind, F.col("problem"), " (", F.col("file"), " line ", F.col("line").cast("string"), ")")
    return first.select(*row("unterminated-quote", message, "correct the syntax, or quote the value", variable=None))


def expansion_unsupported(rel: Relations, config: Config) -> DataFrame:
    """First real declarations of a name in a file that refer to other variables in a file that others load."""
    first = first_per(known(rel.decls.where(~is_sample()), config), ["name", "file"], ["line", "column"])
    return first.where(F.col("shared") & (F.size("references") > 0) & ~is_local()).select(*expansion_unsupported_columns())


def is_local() -> Column:
    return F.col("dev_only") | text.base_name(F.col("file")).endswith(".local")


def expansion_unsupported_columns():
    refs = F.array_join(F.transform("references", lambda r: F.concat(F.lit("${"), r, F.lit("}"))), ", ")
    message = say(F.col("name"), " refers to ", refs, " in ", F.col("file"), ", which many loaders do not expand")
    return row("expansion-unsupported", message, "write the value out")
