"""Explicit schemas of the relations; nothing is inferred."""

from pyspark.sql import types as T

_S, _I, _B, _L = T.StringType(), T.IntegerType(), T.BooleanType(), T.LongType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, len(rest) > 0 and rest[0]) for n, t, *rest in fields])


_STRINGS = T.ArrayType(_S, False)
ISSUE = _struct(("kind", _S), ("message", _S), ("file", _S), ("line", _I), ("column", _I))
DECLS = _struct(
    ("name", _S), ("file", _S), ("line", _I), ("column", _I), ("value", _S), ("has_value", _B), ("quoted", _S, True),
    ("exported", _B), ("references", _STRINGS), ("duplicate_of_line", _I, True), ("leading_comments", _STRINGS),
    ("inline_comment", _S, True), ("unquoted_inline_comment", _S, True), ("has_trailing_whitespace", _B), ("kind", _S),
    ("shared", _B), ("dev_only", _B),
)
USAGES = _struct(
    ("name", _S), ("file", _S), ("line", _I), ("column", _I), ("language", _S), ("accessor", _S), ("has_fallback", _B),
    ("required", _B), ("via_import", _B), ("fallback_literal", _S, True),
)
INFRA = _struct(
    ("name", _S), ("file", _S), ("line", _I), ("column", _I), ("kind", _S), ("required", _B), ("refers_to_file", _B),
    ("interpolation", _B),
)
ENV_FILES = _struct(
    ("path", _S), ("kind", _S), ("exists", _B), ("shared", _B), ("dev_only", _B), ("tracked", _B), ("committed", _B),
    ("decl_count", _I), ("issues", T.ArrayType(ISSUE, False)), ("byte_size", _L),
)
SUPPRESSIONS = _struct(("file", _S), ("line", _I, True), ("rule_id", _S))
DIAGNOSTICS = _struct(("file", _S), ("line", _I), ("column", _I), ("code", _S), ("severity", _S), ("message", _S))
SKIPPED = _struct(("file", _S), ("reason", _S))
FINDING_INPUT = _struct(
    ("rule_id", _S), ("severity", _S, True), ("message", _S), ("file", _S), ("line", _I), ("column", _I),
    ("variable", _S, True), ("hint", _S, True), ("fingerprint", _S, True),
)
RULES = _struct(
    ("rule_id", _S), ("title", _S), ("severity", _S), ("description", _S), ("remediation", _S), ("tags", _STRINGS), ("rule_order", _I)
)
