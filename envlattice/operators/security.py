"""The security rules: names and values that are dangerous to share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envlattice.config import Config
from envlattice.functions import credentials, lists, text
from envlattice.operators.finding import RowRule, row, say
from envlattice.operators.relations import SAMPLE_KINDS, Relations, first_per, ignored, judged, known

PLACE = ["file", "line", "column"]
NAME_LIMIT, SECRET_LENGTH, PASSWORD_LENGTH = 127, 8, 8


def _undeclared(rel: Relations) -> DataFrame:
    return rel.usages.join(rel.decls.select("name").distinct(), "name", "left_anti")


def _first_decls(rel: Relations, config: Config) -> DataFrame:
    return first_per(known(rel.decls, config), ["file", "name"], ["line", "column"])


def listed(names: tuple[str, ...]) -> Column:
    return F.upper("name").isin(sorted({n.upper() for n in names}))


def invalid_name(rel: Relations, config: Config) -> DataFrame:
    """Names, declared or only read, the first of each in a file, that are no identifiers or not in capitals."""
    at = ["name", *PLACE]
    sites = rel.decls.select(*at).unionAll(_undeclared(rel).select(*at))
    first = first_per(known(sites, config), ["file", "name"], ["line", "column"])
    return first.where(is_invalid()).select(*invalid_name_columns())


def is_invalid() -> Column:
    return text.name_defect(F.col("name")).isNotNull() | ~text.is_upper_snake(F.col("name"))


def invalid_name_columns():
    name, defect = F.col("name"), text.name_defect(F.col("name"))
    message = F.when(defect.isNotNull(), say('"', name, '" is no identifier: ', defect)).otherwise(
        say('"', name, '" is not in capitals, digits and underscores, so shells cannot use it everywhere')
    )
    hint = F.when(defect.isNotNull(), "rename it").otherwise(say("rename it to ", text.upper_snake(name)))
    return row("invalid-name", message, hint)


def reserved_name_columns():
    message = say('"', F.col("name"), '" belongs to the system or its tools')
    return row("reserved-name", message, say("use a name such as APP_", F.col("name")))


def reserved_name(rel: Relations, config: Config) -> DataFrame:
    """Declarations of names that the system or its tools own."""
    return _first_decls(rel, config).where(listed(config.reserved_names)).select(*reserved_name_columns())


def hostile_declared_columns():
    severity = F.when(F.col("shared") | ~F.col("dev_only"), "error").otherwise("warn")
    scope = F.when(F.col("shared"), "others load the file").otherwise("the file is a developer's own")
    message = say('"', F.col("name"), '" changes what every process started with it runs; ', scope)
    return row("hostile-name", message, "remove it", severity)


def hostile_read_columns():
    message = say('"', F.col("name"), '" is read, but never declared: whoever sets the environment decides it')
    return row("hostile-name", message, "declare it, or drop the read", "info")


def hostile_name(rel: Relations, config: Config) -> DataFrame:
    """Names that loaders, shells and interpreters act on: declared, or read without being declared."""
    declared = _first_decls(rel, config).where(listed(config.hostile_names)).select(*hostile_declared_columns())
    reads = first_per(known(_undeclared(rel), config), ["file", "name"], ["line", "column"])
    return declared.unionAll(reads.where(listed(config.hostile_names)).select(*hostile_read_columns()))


def is_too_long() -> Column:
    return text.is_env_name(F.col("name")) & (F.length("name") > NAME_LIMIT)


def shell_incompatible_name_columns():
    message = say('"', F.col("name"), '" has ', F.length("name").cast("string"), f" letters; {NAME_LIMIT} are portable")
    return row("shell-incompatible-name", message, "shorten it")


def shell_incompatible_name(rel: Relations, config: Config) -> DataFrame:
    """Identifiers that are too long for some systems."""
    return _first_decls(rel, config).where(is_too_long()).select(*shell_incompatible_name_columns())


def inspected(df: DataFrame, value: Column, name: Column, config: Config) -> DataFrame:
    """Adds what several rules ask of a value, each worked out once a row.

    ``matched``: credential shapes; ``secretish``: of the name; ``digest``; ``plain``: trimmed, in small letters;
    ``password``: of its URL; ``placeholder``: a value or a URL's password that is no real one; ``found``: whether the
    value is taken for a credential, by shape, or by entropy behind a secret-looking name.
    """
    patterns, weak = list(config.secret_patterns), list(config.weak_values)
    df = df.withColumns(
        {
            "matched": text.credential_matches(value, patterns),
            "secretish": text.is_secretish(name, config.secret_name_pattern),
            "digest": text.fingerprint(value),
            "plain": F.lower(text.trimmed(value)),
            "password": text.url_password(value),
        }
    )
    plain = F.col("plain")
    df = df.withColumns(
        {
            "placeholder_value": (plain == "") | plain.isin(weak) | plain.rlike(lists.PLACEHOLDER_VALUE),
            "placeholder_url": F.coalesce(text.is_placeholder_password(F.col("password")), F.lit(False)),
        }
    )
    df = df.withColumn("placeholder", F.col("placeholder_value") | F.col("placeholder_url"))
    made = text.is_machine_made(value, F.col("secretish")) & ~F.col("placeholder")
    ignored_ = F.col("digest").isin(sorted(config.ignore_fingerprints)) if config.ignore_fingerprints else F.lit(False)
    return df.withColumns({"found": (F.size("matched") > 0) | made, "reported": ~ignored_})


def summary() -> Column:
    """What was detected in an inspected row, without the value."""
    names = F.array_sort(F.array_distinct(F.transform("matched", lambda m: m["name"])))
    return F.when(F.size("matched") == 0, "looks machine-made").otherwise(say("looks like: ", F.array_join(names, ", ")))


def examined(rel: Relations, config: Config) -> DataFrame:
    """Judged and inspected declarations: what the row rules run on."""
    return inspected(judged(rel, config), F.col("value"), F.col("name"), config)


def row_rules(config: Config) -> list[RowRule]:
    """The rules that need an examined declaration's row only."""
    name, file, value = F.col("name"), F.col("file"), F.col("value")
    wanted, sample = ~ignored(config), F.col("kind").isin(SAMPLE_KINDS)
    plain, digest, password = F.col("plain"), F.col("digest"), F.col("password")
    long_ = text.utf16_length(value) >= SECRET_LENGTH
    listed = plain.isin(list(config.weak_values))
    reason = F.when(plain == "", "it is empty").when(listed, "it is a known weak value").otherwise("it looks like a placeholder")
    connection = F.exists("matched", lambda m: m["id"].isin(credentials.CONNECTION_IDS))
    real_password = F.coalesce((text.utf16_length(password) >= PASSWORD_LENGTH) & ~F.col("placeholder_url"), F.lit(False))
    found = F.col("found") & F.col("reported")
    return [
        RowRule(
            "weak-secret",
            wanted & ~sample & F.col("secretish") & F.col("placeholder_value"),
            row("weak-secret", say(name, " in ", file, " is no real secret: ", reason), "generate the value", fingerprint=digest),
        ),
        RowRule(
            "secret-in-repo",
            wanted & ~sample & long_ & found,
            row(
                "secret-in-repo",
                say("the value of ", name, " in ", file, " ", summary(), " (", digest, ")"),
                "rotate it, and inject it when deploying",
                F.when(F.col("committed"), "error").otherwise("warn"),
                fingerprint=digest,
            ),
        ),
        RowRule(
            "secret-in-example",
            wanted & sample & long_ & ~F.col("placeholder") & found,
            row(
                "secret-in-example",
                say("the example ", file, " has a real value for ", name, ": it ", summary(), " (", digest, ")"),
                "put a placeholder there, and rotate the credential",
                fingerprint=digest,
            ),
        ),
        RowRule(
            "debug-flag-shared-env",
            wanted & F.col("shared") & ~F.col("kind").isin(*SAMPLE_KINDS, "local", "test")
            & F.upper("name").isin(lists.DEBUG_NAMES) & plain.isin(lists.DEBUG_VALUES),
            row(
                "debug-flag-shared-env",
                say(file, " sets ", name, "=", plain, " for all who load it"),
                say("gate it by a variable such as ", text.upper_snake(F.concat(F.lit("ENABLE_"), name))),
            ),
        ),
        RowRule(
            "hardcoded-connection-string",
            wanted & (sample | ~F.col("secretish")) & connection & real_password & F.col("reported"),
            row(
                "hardcoded-connection-string",
                say(name, " in ", file, " has a password in its connection string (", digest, ")"),
                "keep the host, and inject user and password",
                fingerprint=digest,
            ),
        ),
    ]


def _row_rule(index: int):
    def run(rel: Relations, config: Config) -> DataFrame:
        return row_rules(config)[index].run(examined(rel, config))

    return run


weak_secret, secret_in_repo, secret_in_example, debug_flag_shared_env, hardcoded_connection_string = map(_row_rule, range(5))


def secret_fallback_literal(rel: Relations, config: Config) -> DataFrame:
    """Defaults in code, of secret-looking names, that are credentials themselves."""
    literal, name = F.col("fallback_literal"), F.col("name")
    reads = known(rel.usages.where("fallback_literal is not null and fallback_literal <> ''"), config)
    reads = reads.where(text.is_secretish(name, config.secret_name_pattern))
    seen = inspected(reads, literal, name, config).where("found and reported")
    message = say(name, " is read in ", F.col("file"), " with a default that ", summary(), " (", F.col("digest"), ")")
    return seen.select(*row("secret-fallback-literal", message, "drop the default", fingerprint=F.col("digest")))
