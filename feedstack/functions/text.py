"""String helpers with the semantics of the original service."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's String.trim() removes every char <= U+0020 at both ends; Spark's
# one-argument trim only removes spaces, so trim that exact character set.
_JAVA_TRIM_CHARS = "".join(chr(i) for i in range(0x21))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def java_trim(c) -> Column:
    return F.btrim(_c(c), F.lit(_JAVA_TRIM_CHARS))


def java_trim_long(c) -> Column:
    """``java_trim`` of a long text, which looks at the two end bytes first:
    the plain trim walks the whole text even if there is nothing to trim.
    (Trimmed characters are single bytes, no byte of another is below 0x80.)
    The trim is a lambda, run where needed only: like that of the rules, it
    keeps what makes the text and what reads it in two generated methods,
    as one of both is too large for the JIT."""
    c = _c(c)
    b, space = c.cast("binary"), F.lit(b" ")
    return (F.when((F.substring(b, 1, 1) > space) & (F.substring(b, -1, 1) > space), c)
            .otherwise(F.element_at(F.transform(F.array(c), java_trim), 1)))


def is_blank(c) -> Column:
    """null-safe: true when null or empty after trim."""
    c = _c(c)
    return c.isNull() | (java_trim(c) == F.lit(""))


def has_text(c) -> Column:
    """Non-null and not blank."""
    c = _c(c)
    return F.coalesce(c.isNotNull() & (java_trim(c) != F.lit("")), F.lit(False))


def trim_to_null(c) -> Column:
    """trim, then empty -> null."""
    t = java_trim(c)
    return F.when(t != F.lit(""), t)


def sanitize_text(c) -> Column:
    """trim, collapse runs of whitespace to one space, empty -> null (T4)."""
    t = F.regexp_replace(java_trim(c), r"\s+", " ")
    return F.when(t != F.lit(""), t)


def normalize_text(c) -> Column:
    """trim, lower case, collapse whitespace (content-hash normal form)."""
    return F.regexp_replace(F.lower(java_trim(c)), r"\s+", " ")


def contains_ci(c, needle: str) -> Column:
    """Case-insensitive literal containment (no LIKE wildcards, see Q-21)."""
    return F.contains(F.lower(_c(c)), F.lit(needle.lower()))


def truncate(c, n: int) -> Column:
    """Cut at ``n`` chars."""
    c = _c(c)
    return F.when(F.length(c) > n, F.substring(c, 1, n)).otherwise(c)


def preview(c, n: int = 100) -> Column:
    """First ``n`` chars plus '...' when longer (error records, J8)."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
