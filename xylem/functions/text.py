"""Column functions on values: joining, splitting, coercing and hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values with one of these are quoted when values are joined.
SPECIAL = r'[,"\\\r\n]'


def join_values(values: Column) -> Column:
    """One text from an array of texts: separated by commas, quoted where needed; null for none."""
    quoted = lambda v: F.concat(F.lit('"'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('"'))
    each = F.transform(values, lambda v: F.when(v.rlike(SPECIAL), quoted(v)).otherwise(v))
    return F.when(F.size(values) > 0, F.array_join(each, ","))


def split_values(text: Column) -> Column:
    """The array that join_values made a text of; null for null."""
    parts = F.regexp_extract_all(text, F.lit(r'("(?:[^"\\]|\\.)*"|[^,]+)'), 1)
    plain = lambda v: F.regexp_replace(F.substring(v, F.lit(2), F.char_length(v) - 2), r"\\(.)", "$1")
    return F.transform(parts, lambda v: F.when(v.startswith('"'), plain(v)).otherwise(v))


def tried(value: Column, kind: T.DataType) -> Column:
    """A text as a typed value; null if it isn't one. Booleans are true for `true` and `1`, else false."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.BooleanType):
        return value.isin("true", "1")
    if isinstance(kind, T.BinaryType):
        return F.unhex(value)
    return value.try_cast(kind)


def coerce(value: Column, kind: T.DataType, strict: bool = True) -> Column:
    """A text as a typed value; a text that isn't one is an error, or null if not strict."""
    typed = tried(value, kind)
    if not strict or isinstance(kind, (T.StringType, T.BooleanType)):
        return typed
    told = F.raise_error(F.concat(F.lit(f"not a value of type {kind.simpleString()}: "), value))
    return F.coalesce(typed, F.when(value.isNotNull(), told.cast(kind)))  # casts once where it can


def strip_blank(value: Column) -> Column:
    """Without surrounding white space; null if nothing is left."""
    return F.nullif(F.btrim(value, F.lit(" \t\r\n")), F.lit(""))


def hash_text(value: Column) -> Column:
    """A value in a form that can be joined without ambiguity: `N`, or its length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("N"))


def hash_list(values: Column) -> Column:
    """hash_text of an array: `L`, its size, a colon and each value; `N` for null or no value."""
    body = F.array_join(F.transform(values, hash_text), "")
    return F.when(values.isNull() | (F.size(values) == 0), F.lit("N")).otherwise(F.concat(F.lit("L"), F.size(values).cast("string"), F.lit(":"), body))


def digest(text: Column, how: str = "sha1") -> Column:
    """Lower-case hex digest of a text: sha1, md5, sha256 or sha512; its first bytes if a size stands behind a colon."""
    name, _, size = how.partition(":")
    if size:
        return F.substring(digest(text, name), 1, 2 * int(size))
    if how == "md5":
        return F.md5(text.cast("binary"))
    if how == "sha1":
        return F.sha1(text.cast("binary"))
    return F.sha2(text.cast("binary"), int(how.removeprefix("sha")))
