"""The driver's tables seen as the engine's relations, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envlattice import schemas
from envlattice.operators.relations import Manifest, Relations, with_duplicates


def _name(key: str) -> str:
    special = ["PATH", "NODE_OPTIONS", "DEBUG", "HOME", "my.var", "camelCase", "LD_PRELOAD", "9LIVES", "LOG_LEVEL"]
    cases = " ".join(f"WHEN {key} % 97 = {i + 5} THEN '{n}'" for i, n in enumerate(special))
    prefix = f"CASE {key} % 9 WHEN 1 THEN 'API_TOKEN_' WHEN 0 THEN 'VITE_FLAG_' WHEN 2 THEN 'REACT_APP_' ELSE 'VAR_' END"
    return f"CASE {cases} ELSE CONCAT({prefix}, LPAD(CAST({key} % 900 AS STRING), 4, '0')) END"


_MD5 = "MD5(CAST(o_orderkey AS STRING))"
DECLS = f"""
SELECT CASE WHEN o_custkey % 31 = 4 THEN CONCAT('OLD_', LPAD(CAST(o_custkey % 900 AS STRING), 4, '0'))
            WHEN o_custkey % 67 = 6 THEN CONCAT(REPEAT('LONG_', 26), LPAD(CAST(o_custkey % 900 AS STRING), 4, '0'))
            ELSE {_name("o_custkey")} END AS name,
       CASE place WHEN 0 THEN '.env' WHEN 1 THEN '.env.example' WHEN 2 THEN '.env.local'
            WHEN 3 THEN 'app/.env.production' ELSE '.env.test' END AS file,
       CAST(o_orderkey AS INT) AS line, CAST(1 AS INT) AS col,
       CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'changeme' WHEN 2 THEN 'true'
            WHEN 3 THEN CONCAT('postgres://app:', SUBSTR({_MD5}, 1, 12), '@db/x')
            WHEN 4 THEN CONCAT('AKIA', UPPER(SUBSTR({_MD5}, 1, 16)))
            WHEN 5 THEN CONCAT('two words $HOST ', CAST(o_custkey % 50 AS STRING))
            WHEN 6 THEN {_MD5} ELSE CAST(o_custkey % 50 AS STRING) END AS value,
       CASE WHEN o_orderkey % 4 = 0 THEN '"' END AS quoted,
       o_orderkey % 13 = 0 AS exported,
       CASE WHEN o_orderkey % 11 = 5 THEN 'HOST' END AS ref,
       CASE WHEN o_orderkey % 17 = 0 THEN '# note' END AS comment,
       CASE WHEN o_orderkey % 19 = 0 THEN CONCAT('  about ', o_orderstatus, '  ') END AS above,
       CASE place WHEN 0 THEN 'dev' WHEN 1 THEN 'example' WHEN 2 THEN 'local' WHEN 3 THEN 'production' ELSE 'test' END
         AS kind,
       place IN (0, 3, 4) AS shared, place IN (2, 4) AS dev_only
FROM (SELECT o_orderkey, o_custkey, o_orderstatus,
             CASE WHEN o_custkey % 7 = 0 THEN 2 + 2 * (o_orderkey % 2) WHEN o_custkey % 11 = 0 THEN 1 ELSE o_orderkey % 5 END
               AS place FROM {{orders}}) o"""
USAGES = f"""
SELECT {_name("l_partkey")} AS name, CONCAT('src/mod', CAST(l_suppkey % 20 AS STRING), '.js') AS file,
       CAST(l_orderkey AS INT) AS line, CAST(l_linenumber AS INT) AS col,
       CASE WHEN l_suppkey % 2 = 0 THEN 'javascript' ELSE 'typescript' END AS language,
       CASE WHEN l_suppkey % 3 = 0 THEN 'import.meta.env' ELSE 'process.env' END AS accessor,
       l_discount > 0.05 AS has_fallback, l_quantity >= 25 AS required,
       CASE l_orderkey % 13 WHEN 0 THEN MD5(CAST(l_partkey AS STRING)) WHEN 1 THEN 'dev' WHEN 2 THEN '' END AS fallback_literal
FROM {{lineitem}}"""
INFRA = f"""
SELECT CASE event_id % 8 WHEN 3 THEN CASE user_id % 6 WHEN 0 THEN '.env' WHEN 1 THEN './.env.local' WHEN 2 THEN 'prod.env'
                                          WHEN 3 THEN '../app/.env.production' WHEN 4 THEN 'env/none.env' ELSE '.env.test' END
            ELSE {_name("(event_id * 3 + 1)")} END AS name,
       CASE WHEN event_id % 8 IN (4, 5) THEN '.github/workflows/ci.yml' WHEN user_id % 2 = 0 THEN 'docker-compose.yml'
            ELSE 'deploy/docker-compose.yml' END AS file,
       CAST(event_id AS INT) AS line, CAST(3 AS INT) AS col,
       CASE event_id % 8 WHEN 0 THEN 'compose-environment' WHEN 1 THEN 'compose-interpolation' WHEN 2 THEN 'dockerfile-arg'
            WHEN 3 THEN 'compose-env-file' WHEN 4 THEN 'ci-secret' WHEN 5 THEN 'ci-var' WHEN 6 THEN 'compose-interpolation'
            ELSE 'compose-build-arg' END AS kind,
       event_type = 'error' AS required, event_id % 8 = 3 AS refers_to_file, event_id % 8 IN (1, 6) AS interpolation
FROM {{events}}"""
ENV_FILES = """
SELECT * FROM (VALUES
  ('.env', 'dev', true, true, false, true), ('.env.example', 'example', true, false, false, true),
  ('.env.local', 'local', true, false, true, false), ('app/.env.production', 'production', true, true, false, false),
  ('.env.test', 'test', true, true, true, true), ('gone/.env', 'unknown', false, false, true, false))
  AS t(path, kind, present, shared, dev_only, committed)"""
SUPPRESSIONS = """
SELECT '.env' AS file, CAST(o_orderkey AS INT) AS line, 'unused-variable' AS rule_id FROM {orders} WHERE o_orderkey % 35 = 0
UNION ALL SELECT 'src/mod3.js', NULL, 'missing-in-env'
UNION ALL SELECT '.env.test', NULL, 'unquoted-special-chars'"""
MANIFEST = Manifest(path="package.json", name="app", dependencies=("React",), dev_dependencies=("typescript",))

#: The same for DuckDB, as common table expressions; ``decls`` with ``dup``, the line of a key's first assignment.
ORACLE = "WITH " + ",\n".join(
    [
        f"decls0 AS ({DECLS.format(orders='orders')})",
        "decls AS (SELECT *, value <> '' AS has_value, first_value(line) OVER (PARTITION BY file, name ORDER BY line "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dup FROM decls0)",
        f"usages AS ({USAGES.format(lineitem='lineitem')})",
        f"infra AS ({INFRA.format(events='events')})",
        f"env_files AS ({ENV_FILES})",
        f"suppressions AS ({SUPPRESSIONS.format(orders='orders')})",
    ]
)


def relations(spark: SparkSession, sf_dir: str) -> Relations:
    """The projected relations; only the columns that they need are read."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem", "events")}
    decls = spark.sql(DECLS, orders=t["orders"])
    strings = "array<string>"
    decls = with_duplicates(
        decls.select(
            "name", "file", "line", F.col("col").alias("column"), "value", (F.col("value") != "").alias("has_value"), "quoted",
            "exported", F.coalesce(F.array_compact(F.array("ref")), F.array().cast(strings)).alias("references"),
            F.lit(None).cast("int").alias("duplicate_of_line"), F.array_compact(F.array("above")).alias("leading_comments"),
            F.lit(None).cast("string").alias("inline_comment"), F.col("comment").alias("unquoted_inline_comment"),
            F.lit(False).alias("has_trailing_whitespace"), "kind", "shared", "dev_only",
        )
    )
    usages = spark.sql(USAGES, lineitem=t["lineitem"]).withColumnRenamed("col", "column").withColumn("via_import", F.lit(False))
    infra = spark.sql(INFRA, events=t["events"]).withColumnRenamed("col", "column")
    issue = schemas.ENV_FILES["issues"].dataType
    bad = F.array(
        F.struct(F.lit("no-separator").alias("kind"), F.lit("no separator").alias("message"), F.col("path").alias("file"),
                 F.lit(3).alias("line"), F.lit(1).alias("column")),
    )
    files = spark.sql(ENV_FILES).withColumnRenamed("present", "exists").withColumns(
        {
            "tracked": F.col("committed"),
            "decl_count": F.lit(0),
            "issues": F.when(F.col("path") == ".env.test", bad.cast(issue)).otherwise(F.array().cast(issue)),
            "byte_size": F.lit(0).cast("long"),
        }
    )
    suppressions = spark.sql(SUPPRESSIONS, orders=t["orders"])
    return Relations(
        decls, usages.select(*schemas.USAGES.fieldNames()), infra, files.select(*schemas.ENV_FILES.fieldNames()), suppressions, MANIFEST
    )
