"""The 28 rules as a dimension: ids, severities and tags are fixed, the wording is ours."""

from pyspark.sql import DataFrame, SparkSession

from envlattice import schemas

SEVERITIES = ["info", "warn", "error"]
DOCS = "docs/rules.md"
#: (id, severity, tag, title, remediation), in order of registration.
RULES = [
    ("missing-in-env", "error", "correctness", "Read but never declared", "Declare it in the shared env file and list it in the example file."),
    ("missing-from-example", "error", "docs", "Not in the example file", "List it, with an empty or placeholder value, in the example file."),
    ("unused-variable", "warn", "hygiene", "Declared but never used", "Remove the declaration, or read the variable where it is needed."),
    ("prod-crash", "error", "correctness", "A required read that only developers' files serve", "Declare it in a shared file or give the read a default."),
    ("example-out-of-sync", "error", "docs", "Example file and project disagree", "Drop entries that nothing uses, or add an example file."),
    ("ci-secret-undeclared", "warn", "docs", "CI secret that no example file lists", "List the name, without a value, in the example file."),
    ("compose-var-undeclared", "warn", "consistency", "Compose variable without a source", "Declare it, set it under environment, or give it a default."),
    ("env-file-missing", "error", "correctness", "Referenced env file does not exist", "Create the file or correct the path."),
    ("env-file-untracked", "error", "correctness", "Referenced env file will not be deployed", "Commit a template, or inject the variables when deploying."),
    ("framework-prefix-mismatch", "warn", "consistency", "Prefix of a framework that is not used", "Use the prefix of the project's bundler, or add the dependency."),
    ("duplicate-key", "error", "correctness", "Key assigned twice in a file", "Keep one of the assignments."),
    ("conflicting-values", "warn", "consistency", "Different values in different files", "Make the values agree, or name files by environment."),
    ("empty-value", "info", "hygiene", "Key without a value", "Give it a value, or move the name to the example file."),
    ("unquoted-special-chars", "warn", "hygiene", "Special letters outside quotes", "Put the value in double quotes."),
    ("inline-comment-truncation", "warn", "hygiene", "Comment behind an unquoted value", "Put the comment on a line of its own."),
    ("export-prefix", "info", "hygiene", "Assignment with export", "Drop the keyword."),
    ("unterminated-quote", "error", "correctness", "Line that cannot be parsed", "Correct the syntax, or quote the value."),
    ("expansion-unsupported", "warn", "consistency", "Reference inside a shared value", "Write the value out."),
    ("invalid-name", "warn", "hygiene", "Name that shells cannot use", "Use capitals, digits and underscores only."),
    ("reserved-name", "warn", "correctness", "Name that the system owns", "Use a name of the application's own."),
    ("hostile-name", "error", "security", "Name that loaders or shells act on", "Remove it from files that others load."),
    ("shell-incompatible-name", "warn", "hygiene", "Name that is not portable", "Keep it below 128 ASCII letters."),
    ("weak-secret", "warn", "security", "Secret with a weak value", "Generate the value, and inject it when deploying."),
    ("secret-in-repo", "error", "security", "Credential in an env file", "Rotate it, and inject it when deploying."),
    ("secret-in-example", "error", "security", "Credential in an example file", "Put a placeholder there, and rotate the credential."),
    ("secret-fallback-literal", "error", "security", "Credential as a default in code", "Drop the default, and fail where the variable is absent."),
    ("debug-flag-shared-env", "warn", "security", "Debugging on in a shared file", "Remove it, or gate it by a variable that is off by default."),
    ("hardcoded-connection-string", "error", "security", "Password in a connection string", "Keep the host, and inject user and password."),
]
IDS = [r[0] for r in RULES]


def docs_url(rule_id: str) -> str:
    return f"{DOCS}#{rule_id}"


def rules(spark: SparkSession) -> DataFrame:
    rows = [(i, title, severity, title, fix, [tag], n) for n, (i, severity, tag, title, fix) in enumerate(RULES)]
    return spark.createDataFrame(rows, schemas.RULES)
