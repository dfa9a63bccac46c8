"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import credentials, globs, lists

#: Blanks that the script language of the sources trims: Unicode's, line ends and the byte order mark.
BLANK = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def fingerprint(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 12)


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, f"^{BLANK}+|{BLANK}+\\z", "")


def utf16_length(value: Column) -> Column:
    return F.length(value) + F.regexp_count(value, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def truncate(value: Column, limit: int) -> Column:
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(F.substring(value, 1, max(0, limit - 1)), F.lit("…")))


def preview(value: Column, hidden: Column, limit: int = 48) -> Column:
    """One printable line: hidden values are redacted, line ends spelt out, long ones cut."""
    flat = F.regexp_replace(value, "\r?\n", r"\\n")
    return F.when(hidden & (value != ""), "<redacted>").otherwise(truncate(flat, limit))


def mask(value: Column) -> Column:
    n = F.length(value)
    return F.when(n == 0, "<empty>").when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.lit("***"), F.right(value, F.lit(2))))


def entropy(value: Column) -> Column:
    """Bits a character of a string's own letter frequencies; 0 for the empty string."""
    letters = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))
    n = F.length(value).cast("double")
    share = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))).cast("double") / n
    bits = F.aggregate(F.array_sort(F.array_distinct(letters)), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    return F.when(F.length(value) == 0, 0.0).otherwise(bits)


def is_secretish(name: Column, pattern: str = lists.SECRET_NAME) -> Column:
    return name.rlike(f"(?i){pattern}")


def matches_any(value: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    found = globs.any_glob(patterns, ignore_case)
    return value.rlike(found) if found else F.lit(False)


def is_env_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z")


def is_upper_snake(name: Column) -> Column:
    return name.rlike(r"^[A-Z][A-Z0-9_]*\z")


def has_control_characters(value: Column) -> Column:
    return value.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def upper_snake(name: Column) -> Column:
    """A suggestion for a name: words set apart at capitals, other letters as underscores, none in front."""
    apart = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    snake = F.regexp_replace(F.upper(F.regexp_replace(apart, "[^A-Za-z0-9_]", "_")), "^_+", "")
    return F.when(snake != "", snake).otherwise(F.concat(F.lit("APP_"), name))


def name_defect(name: Column) -> Column:
    """What keeps a name from being an identifier, or null."""
    bad = F.regexp_extract(name, "(?s)[^A-Za-z0-9_]", 0)
    label = F.concat(F.lit("U+"), F.lpad(F.hex(F.conv(F.hex(F.encode(bad, "UTF-32")), 16, 10).cast("long")), 4, "0"))
    return (
        F.when(name == "", "the name is empty")
        .when(name.rlike("^[0-9]"), F.concat(F.lit("it starts with the digit "), F.substring(name, 1, 1)))
        .when(bad != "", F.concat(F.lit("it contains "), F.when(bad.rlike(r"[\x21-\x7E]"), bad).otherwise("a character"), F.lit(" ("), label, F.lit(")")))
    )


def special_classes(value: Column) -> Column:
    """Labels of the letters that other loaders would not take as they are, in a fixed order."""
    tests = [
        ("whitespace", BLANK), ("#", "#"), ("$", r"\$"), ("'", "'"), ('"', '"'), ("\\", r"\\"), ("=", "="),
        ("a line break", r"[\r\n]"),
    ]
    return F.array_compact(F.array(*(F.when(value.rlike(p), label) for label, p in tests)))


def url_password(value: Column) -> Column:
    """The password of the first URL that has one of three letters or more, among the first eight; else null."""
    parts = F.split(value, "://")

    def password(i: Column) -> Column:
        rest = F.array_join(F.slice(parts, i + 1, F.size(parts)), "://")
        colon = F.locate(":", rest)
        after = F.call_function("locate", F.lit("@"), rest, colon + 1)
        found = (colon > 1) & (after - colon - 1 >= 3)
        return F.when(found, F.substring(rest, colon + 1, after - colon - 1))

    each = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(8))), password)
    return F.when(F.size(parts) > 1, F.get(F.array_compact(each), 0))


def is_placeholder_password(password: Column) -> Column:
    plain = F.lower(trimmed(password))
    return plain.isin(lists.PLACEHOLDER_PASSWORDS) | plain.rlike(r"^<.*>\z|^x+\z")


def is_placeholder_url(value: Column) -> Column:
    return F.coalesce(is_placeholder_password(url_password(value)), F.lit(False))


def is_placeholder_value(value: Column, weak: list[str]) -> Column:
    plain = F.lower(trimmed(value))
    return (plain == "") | plain.isin(weak) | plain.rlike(lists.PLACEHOLDER_VALUE)


def credential_matches(value: Column, patterns: list[tuple[str, str, str]]) -> Column:
    """(id, name) of every credential shape found in a value. No built-in shape is shorter than eight letters."""
    each = (F.when(value.rlike(p), F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"))) for i, n, p in patterns)
    found = F.array_compact(F.array(*each))
    if [tuple(p) for p in patterns] != credentials.PATTERNS:
        return found
    return F.when(F.length(value) >= credentials.SHORTEST, found).otherwise(F.array().cast("array<struct<id:string,name:string>>"))


def is_machine_made(value: Column, secretish: Column) -> Column:
    """High entropy behind a secret-looking name."""
    long_ = F.length(value) >= credentials.ENTROPY_LENGTH
    return F.when(secretish & long_ & ~value.rlike(BLANK), entropy(value) >= credentials.ENTROPY_BITS).otherwise(False)


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def folder_of(path: Column) -> Column:
    return F.when(F.locate("/", path) > 1, F.regexp_replace(path, "/[^/]*\\z", "")).otherwise("")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def resolve_path(folder: Column, reference: Column) -> Column:
    """A path from a folder, dots and double dots folded; double dots at the top stay there."""
    parts = F.split(F.concat_ws("/", folder, posix(reference)), "/")

    def step(out: Column, part: Column) -> Column:
        up = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(part.isin("", "."), out).when(part == "..", up).otherwise(F.concat(out, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def relative_posix(root: str, absolute: Column) -> Column:
    top, path = root.replace("\\", "/").rstrip("/"), posix(absolute)
    return F.when(path.startswith(top), F.regexp_replace(F.substring(path, len(top) + 1, 1 << 30), "^/+", "")).otherwise(path)


def line_of(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, offset: Column) -> Column:
    """The 1-based column of a 0-based offset within its line."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1


def line_text(text: Column, line: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.get(F.split(text, "\n"), line - 1), "\r\\z", ""), F.lit(""))


def count_lines(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")))


def markdown_cell(value: Column, limit: int = 60, empty: str = "—") -> Column:
    """A markdown cell: one line, marks escaped, of bounded length; a dash for nothing."""
    flat = F.regexp_replace(value, "\r?\n", " ")
    for mark in "|`":
        flat = F.replace(flat, F.lit(mark), F.lit("\\" + mark))
    short = F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))
    return F.when(F.coalesce(value, F.lit("")) == "", empty).otherwise(short)
