"""The relations that rules query, and what several rules need to know of their rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envlattice.config import Config
from envlattice.functions import lists, text

SAMPLE_KINDS = ["example", "template"]


@dataclass(frozen=True)
class Manifest:
    """A package manifest, and the dependencies of all others in the project."""

    path: str | None = None
    name: str | None = None
    dependencies: tuple[str, ...] = ()
    dev_dependencies: tuple[str, ...] = ()
    scripts: dict[str, str] = field(default_factory=dict)
    engines: dict[str, str] = field(default_factory=dict)
    related_dependencies: tuple[str, ...] = ()

    @property
    def all_dependencies(self) -> set[str]:
        return {d.lower() for d in (*self.dependencies, *self.dev_dependencies, *self.related_dependencies)}


@dataclass(frozen=True)
class Relations:
    """Who declares, who reads, who references, and the files: one DataFrame each."""

    decls: DataFrame
    usages: DataFrame
    infra: DataFrame
    env_files: DataFrame
    suppressions: DataFrame | None = None
    manifest: Manifest | None = None

    def cached(self) -> Relations:
        """Computed once for all rules; the relations are what extraction leaves of a tree, not its texts."""
        from dataclasses import replace

        return replace(
            self, decls=self.decls.persist(), usages=self.usages.persist(), infra=self.infra.persist(), env_files=self.env_files.persist()
        )


def ignored(config: Config, name: Column | str = "name") -> Column:
    return text.matches_any(F.col(name) if isinstance(name, str) else name, list(config.ignore_variables), ignore_case=True)


def known(df: DataFrame, config: Config) -> DataFrame:
    """Without the variables that the configuration ignores; pushed to the relation's scan."""
    return df.where(~ignored(config)) if config.ignore_variables else df


def is_example_path(path: Column, config: Config) -> Column:
    return (
        text.base_name(path).isin(lists.EXAMPLE_BASENAMES)
        | text.matches_any(path, lists.EXAMPLE_GLOBS)
        | text.matches_any(path, list(config.example_files), ignore_case=True)
    )


def judged(rel: Relations, config: Config) -> DataFrame:
    """Declarations with ``example`` (in the sense of the contract rules), ``committed`` and ``dev_only_any``.

    A file that is not in the report counts as committed.
    """
    files = rel.env_files.select(
        F.col("path").alias("file"),
        F.col("kind").alias("file_kind"),
        F.col("committed").alias("file_committed"),
        F.col("dev_only").alias("file_dev_only"),
    )
    joined = rel.decls.join(files, "file", "left")
    example = F.col("kind").isin(SAMPLE_KINDS) | F.coalesce(F.col("file_kind").isin(SAMPLE_KINDS), F.lit(False))
    return joined.withColumns(
        {
            "example": example | is_example_path(F.col("file"), config),
            "committed": F.coalesce("file_committed", F.lit(True)),
            "dev_only_any": F.col("dev_only") | F.coalesce("file_dev_only", F.lit(False)),
        }
    ).drop("file_kind", "file_committed", "file_dev_only")


def example_paths(rel: Relations, decls: DataFrame, config: Config) -> DataFrame:
    """(path) of all example files: by kind, name or declarations."""
    by_file = rel.env_files.where(F.col("kind").isin(SAMPLE_KINDS) | is_example_path(F.col("path"), config)).select("path")
    return by_file.union(decls.where("example").select("file")).distinct()


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key; all columns break ties, so equal places give one result whatever the partitions."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    window = Window.partitionBy(*keys).orderBy(*order, *rest)
    return df.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def with_duplicates(decls: DataFrame) -> DataFrame:
    """``duplicate_of_line``: the line of a key's first declaration in the file, null for that one itself."""
    window = Window.partitionBy("file", "name").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return decls.withColumn("duplicate_of_line", F.first("line").over(window))


def names(rel: Relations) -> DataFrame:
    """All distinct names, from declarations, reads and references."""
    return rel.decls.select("name").union(rel.usages.select("name")).union(rel.infra.select("name")).distinct()


def missing_files(infra: DataFrame, env_files: DataFrame) -> DataFrame:
    """Rows for env files that are referenced but not there: neither their resolved path nor their bare name is known."""
    known_paths = env_files.select(F.col("path").alias("resolved"))
    bare = env_files.select(text.base_name(F.col("path")).alias("name")).distinct()
    refs = infra.where("refers_to_file and name <> ''").select(
        "name", text.resolve_path(text.folder_of(F.col("file")), F.col("name")).alias("resolved")
    )
    absent = refs.join(known_paths, "resolved", "left_anti").join(bare, "name", "left_anti")
    facts = {
        "kind": F.lit("unknown"), "exists": F.lit(False), "shared": F.lit(False), "dev_only": F.lit(True),
        "tracked": F.lit(False), "committed": F.lit(False), "decl_count": F.lit(0),
        "issues": F.array().cast(env_files.schema["issues"].dataType), "byte_size": F.lit(0).cast("long"),
    }
    return absent.select(F.col("resolved").alias("path")).distinct().withColumns(facts)
