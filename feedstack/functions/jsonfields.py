"""Typed access into a parsed JSON line (a VARIANT column).

A line is parsed once with ``try_parse_json``; every field is then read with
``try_variant_get`` so that one field of the wrong type never voids the rest
of the line.  The helpers reproduce the coercions of the original reader:
``as_text`` (any scalar printed as text, containers -> ''), ``as_int``
(numbers truncated, numeric text parsed, junk -> 0, booleans -> 1/0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import java_trim

STRING, NUMBER, BOOLEAN, OBJECT, ARRAY, NULL = "string", "number", "boolean", "object", "array", "null"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def node(v, path: str) -> Column:
    """Sub-value at ``path`` as VARIANT; SQL null when the path is absent."""
    return F.try_variant_get(_c(v), path, "variant")


def kind(v, path: str) -> Column:
    """JSON kind of the value at ``path``; null when absent.

    The first character of the value's JSON text tells the kind; for scalars
    this text is a few bytes long."""
    return kind_of_char(F.substring(F.to_json(node(v, path)), 1, 1))


def kind_of_char(first: Column) -> Column:
    """Kind from the first character of a value's JSON text."""
    kinds = F.array(*[F.lit(k) for k in (NUMBER, STRING, OBJECT, ARRAY, NULL, BOOLEAN, BOOLEAN)])
    return F.get(kinds, F.position(first, F.lit('"{[ntf')))


def raw_text(v, path: str) -> Column:
    """The value printed as text (strings unquoted, numbers as written,
    containers as JSON); null when absent or JSON null."""
    return F.try_variant_get(_c(v), path, "string")


def as_text(v, path: str, k: Column | None = None) -> Column:
    """Text of a scalar; '' for objects/arrays; null when absent or null."""
    k = kind(v, path) if k is None else k
    return text_of(k, raw_text(v, path))


def text_of(k: Column, text: Column) -> Column:
    return F.when(k.isin(OBJECT, ARRAY), F.lit("")).when(k != NULL, text)


def parse_int_lenient(text: Column) -> Column:
    """Numeric text -> int the lenient way: strict integer text parses,
    other numeric text is truncated, anything else is 0."""
    t = java_trim(text)
    strict = t.rlike(r"^[+-]?[0-9]+\z")
    return (F.when(strict, F.coalesce(t.try_cast("int"), F.lit(0)))
            .otherwise(F.coalesce(t.try_cast("double").try_cast("int"), F.lit(0))))


def as_int(v, path: str, k: Column | None = None) -> Column:
    """Root integer field: numbers truncated, text parsed leniently,
    booleans 1/0, containers 0, absent/null -> null."""
    k = kind(v, path) if k is None else k
    return int_of(k, raw_text(v, path))


def int_of(k: Column, text: Column) -> Column:
    """Lenient int of a value of kind ``k`` printed as ``text``."""
    return (F.when(k == NUMBER, F.coalesce(text.try_cast("double").try_cast("int"), F.lit(0)))
            .when(k == STRING, parse_int_lenient(text))
            .when(k == BOOLEAN, F.when(text == "true", 1).otherwise(0))
            .when(k.isin(OBJECT, ARRAY), F.lit(0))
            .cast("int"))


def variant_int(v: Column) -> Column:
    """``try_variant_get(v, "$", "int")``, which is left to values whose JSON text is no int."""
    return F.coalesce(F.to_json(v).try_cast("int"), F.try_variant_get(v, "$", "int"))


def strict_integer_text(text: Column) -> Column:
    """True for text a strict integer parser accepts (no blanks, optional sign)."""
    return text.rlike(r"^[+-]?[0-9]+\z")
