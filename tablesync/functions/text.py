"""Column expressions for decoded log text, checksums and clamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups: ordinal, raw value. A comment is stripped only outside quotes.
ASSIGNMENT = r"^@\s*(\d+)\s*=\s*('(?:[^'\\]|\\.|'')*'|(?:(?!/\*).)*?)\s*(?:/\*.*)?$"


def table_name(reference: Column) -> Column:
    """Last part of a possibly quoted and qualified table reference; what follows a blank is dropped."""
    first = F.split(F.trim(reference), r"\s+")[0]
    return F.replace(F.element_at(F.split(first, r"\."), -1), F.lit("`"), F.lit(""))


def assignment_ordinal(body: Column) -> Column:
    """N of @N=value, null if the text is no assignment."""
    return F.when(F.rlike(body, F.lit(ASSIGNMENT)), F.regexp_extract(body, ASSIGNMENT, 1).cast("int"))


def assignment_value(body: Column) -> Column:
    """struct(text, is_null): bare NULL is null, a quoted 'NULL' is text."""
    return assigned(F.regexp_extract(body, ASSIGNMENT, 2))


def assigned(raw: Column) -> Column:
    """assignment_value of what stands behind the sign, without a comment."""
    quoted = F.rlike(raw, F.lit(r"(?s)^'.*'$")) & (F.length(raw) >= 2)
    is_null = raw == "NULL"
    text = F.when(quoted, unquote(raw.substr(F.lit(2), F.length(raw) - 2))).otherwise(raw)
    return F.struct(F.when(~is_null, text).alias("text"), is_null.alias("is_null"))


def unquote(inner: Column) -> Column:
    r"""\' to ', '' to ', then \\ to \."""
    out = F.replace(inner, F.lit("\\'"), F.lit("'"))
    out = F.replace(out, F.lit("''"), F.lit("'"))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def marker_offset(line: Column) -> Column:
    """N of a '# at N' line, else null."""
    pattern = r"^# at (\d+)\s*$"
    return F.when(F.rlike(line, F.lit(pattern)), F.regexp_extract(line, pattern, 1).cast("long"))


def rotate_target(line: Column) -> Column:
    """File named by a 'Rotate to F' event line, else null."""
    pattern = r"Rotate to (\S+)"
    return F.when(F.rlike(line, F.lit(pattern)), F.regexp_extract(line, pattern, 1))


def checksum_text(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def clamp(x: Column) -> Column:
    """Null and negative numbers become 0."""
    return F.greatest(F.coalesce(x.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
