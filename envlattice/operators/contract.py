"""The contract rules: where those who declare, read and reference variables disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envlattice.config import Config
from envlattice.functions import lists, text
from envlattice.operators.finding import RowRule, row, say
from envlattice.operators.relations import Relations, example_paths, first_per, ignored, judged, known


def _names_of(df: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    return (df.where(F.col("kind").isin(kinds)) if kinds else df).select("name").distinct()


def _unused(df: DataFrame, rel: Relations) -> DataFrame:
    """Rows whose name nobody reads or references."""
    return df.join(_names_of(rel.usages), "name", "left_anti").join(_names_of(rel.infra), "name", "left_anti")


# The findings' columns, over rows that have what they name: used by each rule alone and by all rules together.


def missing_in_env_columns():
    message = say(F.col("name"), " is read in ", F.col("file"), ", but no env file declares it")
    return row("missing-in-env", message, "declare it in the shared env file and list it in the example file")


def missing_from_example_columns():
    message = say(F.col("name"), " is declared in ", F.col("file"), ", but ", F.col("example_path"), " does not list it")
    return row("missing-from-example", message, say("add ", F.col("name"), " to ", F.col("example_path")))


def unused_variable_columns():
    message = say(F.col("name"), " is declared, but code, compose, Docker and CI never use it")
    return row("unused-variable", message, "remove it, or use it where it is needed")


def prod_crash_columns():
    files = F.array_join("files", ", ")
    message = say(F.col("name"), " is required in ", F.col("file"), ", but only ", files, " declares it")
    return row("prod-crash", message, "declare it in a shared file, or give the read a default")


def example_out_of_sync_columns():
    message = say(F.col("name"), " is listed in ", F.col("file"), ", but declared and used nowhere else")
    return row("example-out-of-sync", message, "remove the entry, or use the variable")


def ci_secret_undeclared_columns():
    message = say(F.col("name"), " is a secret in ", F.col("file"), ", but no example file lists it")
    return row("ci-secret-undeclared", message, say("add ", F.col("name"), "= to the example file"))


def compose_var_undeclared_columns():
    message = say(F.col("name"), " is used in ", F.col("file"), ", but neither declared nor set under environment")
    hint = F.when(F.col("required"), "set it, or compose will not start").otherwise("declare it, or give it a default")
    return row("compose-var-undeclared", message, hint, F.when(F.col("required"), "error").otherwise("info"))


def missing_in_env(rel: Relations, config: Config) -> DataFrame:
    """Reads, the first of a name in a file, that nothing declares and the system does not set."""
    reads = known(rel.usages, config).where(~F.col("name").isin(lists.AMBIENT_NAMES))
    undeclared = reads.join(_names_of(rel.decls), "name", "left_anti").join(
        _names_of(rel.infra, lists.DECLARING_KINDS), "name", "left_anti"
    )
    return first_per(undeclared, ["name", "file"], ["line", "column"]).select(*missing_in_env_columns())


def missing_from_example(rel: Relations, config: Config) -> DataFrame:
    """Declarations in real files, the first of a name in each, that no example file lists, if there is an example."""
    decls = judged(rel, config)
    example = example_paths(rel, decls, config).agg(F.min("path").alias("example_path")).where("example_path is not null")
    documented = decls.where("example").select("name").distinct()
    real = first_per(known(decls.where("not example"), config), ["name", "file"], ["line", "column"])
    found = real.drop("example").join(documented, "name", "left_anti").crossJoin(F.broadcast(example))  # one row or none
    return found.select(*missing_from_example_columns())


def unused_variable(rel: Relations, config: Config) -> DataFrame:
    """The first declaration of each name that nobody reads or references."""
    first = first_per(_unused(known(rel.decls, config), rel), ["name"], ["file", "line", "column"])
    return first.select(*unused_variable_columns())


def prod_crash(rel: Relations, config: Config) -> DataFrame:
    """Required reads, the first of a name in a file, of names that only developers' files declare and CI does not inject."""
    decls = judged(rel, config)
    served = known(decls, config).groupBy("name").agg(
        F.every("dev_only_any").alias("dev_only"), F.array_sort(F.collect_set("file")).alias("files")
    )
    served = served.where("dev_only").join(_names_of(rel.infra, ["ci-secret"]), "name", "left_anti").select("name", "files")
    reads = first_per(rel.usages.where("required"), ["name", "file"], ["line", "column"])
    return reads.join(served, "name").select(*prod_crash_columns())


def example_out_of_sync(rel: Relations, config: Config) -> DataFrame:
    """Entries of example files that nothing else knows; or, without any example file, the first declaration."""
    decls = judged(rel, config)
    paths = example_paths(rel, decls, config)
    elsewhere = decls.where("not example").select("name").distinct()
    lone = _unused(known(decls.where("example"), config), rel).join(elsewhere, "name", "left_anti")
    lone = first_per(lone, ["name"], ["file", "line", "column"])
    entries = lone.select(*example_out_of_sync_columns())
    return entries.unionAll(no_example_file(decls, paths)) if config.require_example_file else entries


def no_example_file(decls: DataFrame, paths: DataFrame) -> DataFrame:
    """The first declaration, if there is no example file."""
    # the only declaration that counts is the first one of all; one row for all partitions to agree on
    none = paths.agg(F.count("*").alias("n")).where("n = 0").select("n")
    first = decls.where("not example").orderBy("file", "line", "column", "name").limit(1)
    first = first.crossJoin(F.broadcast(none))
    message = say("there is no example file, so ", F.col("name"), " and all other variables are undocumented")
    return first.select(*row("example-out-of-sync", message, "add an example file"))


def ci_secret_undeclared(rel: Relations, config: Config) -> DataFrame:
    """Secrets of CI, by kind and name, that no example file lists."""
    documented = judged(rel, config).where("example").select("name").distinct()
    refs = known(rel.infra.where("kind = 'ci-secret'"), config).where(text.is_secretish(F.col("name"), config.secret_name_pattern))
    return refs.join(documented, "name", "left_anti").select(*ci_secret_undeclared_columns())


def compose_var_undeclared(rel: Relations, config: Config) -> DataFrame:
    """Compose interpolations that neither an env file declares nor an environment sets."""
    refs = known(rel.infra.where("kind = 'compose-interpolation'"), config)
    found = refs.join(_names_of(rel.decls), "name", "left_anti").join(
        _names_of(rel.infra, ["compose-environment"]), "name", "left_anti"
    )
    return found.select(*compose_var_undeclared_columns())


def file_references(rel: Relations, config: Config) -> DataFrame:
    """File references, the first of a target in a file, with the env file that they resolve to, if any exists.

    A target with a folder is resolved as it is; a bare name is looked for beside the referrer and then at the top.
    """
    target = F.regexp_replace(text.posix(F.col("name")), r"^\./", "")
    refs = rel.infra.where("refers_to_file").withColumn("target", target)
    refs = refs.where(~ignored(config, F.col("target"))) if config.ignore_variables else refs
    refs = first_per(refs, ["file", "target"], ["line", "column"])
    folder = text.folder_of(F.col("file"))
    resolved = F.when(folder == "", F.col("target")).otherwise(text.resolve_path(folder, F.col("target")))
    both = F.when(F.col("target").contains("/") | (folder == ""), F.array(resolved)).otherwise(F.array(resolved, "target"))
    keys = ["file", "target"]
    asked = refs.select(*keys, F.posexplode(both).alias("pos", "path"))
    files = rel.env_files.where("exists").select("path", "dev_only", "committed")
    hit = asked.join(files, "path").groupBy(*keys).agg(F.min_by(F.struct("path", "dev_only", "committed"), "pos").alias("hit"))
    return refs.join(hit, keys, "left")


def file_rules() -> list[RowRule]:
    """The rules over resolved references."""
    missing = say(F.col("file"), " refers to ", F.col("target"), ", which does not exist")
    reason = F.when(F.col("hit.dev_only"), "is a developers' file").otherwise("is not committed")
    untracked = say(F.col("file"), " refers to ", F.col("target"), ", which ", reason)
    fix = "commit a template, or inject the variables when deploying"
    return [
        RowRule(
            "env-file-missing", F.col("hit").isNull(), row("env-file-missing", missing, "create the file, or correct the path", variable=None)
        ),
        RowRule(
            "env-file-untracked", F.col("hit.dev_only") | ~F.col("hit.committed"), row("env-file-untracked", untracked, fix, variable=None)
        ),
    ]


def env_file_missing(rel: Relations, config: Config) -> DataFrame:
    """References to env files that do not exist."""
    return file_rules()[0].run(file_references(rel, config))


def env_file_untracked(rel: Relations, config: Config) -> DataFrame:
    """References to env files that are developers' own or not committed."""
    return file_rules()[1].run(file_references(rel, config))


def unmet_prefix(rel: Relations) -> tuple[Column, Column]:
    """(the framework prefix that a name has, the packages of which the project has none), nulls where all is well."""
    have = rel.manifest.all_dependencies if rel.manifest else set()
    prefix = unmet = F.lit(None).cast("string")
    for p, packages in reversed(lists.FRAMEWORK_PREFIXES):  # the first of the list that fits counts
        fits = F.col("name").startswith(p)
        lacking = rel.manifest is not None and not have & set(packages)
        prefix = F.when(fits, p).otherwise(prefix)
        unmet = F.when(fits, F.lit(", ".join(packages) if lacking else None).cast("string")).otherwise(unmet)
    return prefix, unmet


def framework_prefix_mismatch_columns():
    message = say(F.col("name"), " has the prefix ", F.col("prefix"), ", but the project depends on none of ", F.col("unmet"))
    return row("framework-prefix-mismatch", message, "use the bundler's own prefix, or add the dependency")


def framework_prefix_mismatch(rel: Relations, config: Config) -> DataFrame:
    """Names, the first of each in a file, with the prefix of a framework that the project does not depend on."""
    prefix, unmet = unmet_prefix(rel)
    named = known(rel.decls, config).withColumns({"prefix": prefix, "unmet": unmet}).where("unmet is not null")
    return first_per(named, ["name", "file"], ["line", "column"]).select(*framework_prefix_mismatch_columns())
