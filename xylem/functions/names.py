"""Names of tables and columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest identifier that is kept as it is.
LONGEST = 63


def short_name(name: str, longest: int = LONGEST) -> str:
    """The name, or its beginning, `_` and 7 hex digits of its MD5 if it is too long."""
    if len(name) <= longest:
        return name
    return f"{name[: longest - 8]}_{hashlib.md5(name.encode()).hexdigest()[:7]}"


def short_name_column(name: Column, longest: int = LONGEST) -> Column:
    """short_name over a column."""
    cut = F.concat(F.substring(name, 1, longest - 8), F.lit("_"), F.substring(F.md5(name.cast("binary")), 1, 7))
    return F.when(F.char_length(name) <= longest, name).otherwise(cut)


def key_name(field: str, child: str) -> str:
    """Foreign key column of a parent row to its only child."""
    return f"fk_{field}" if field.endswith(child) else f"{field}_fk_{child}"


def link_name(parent: str, field: str, child: str) -> str:
    """Table that links parents and shared children."""
    return f"{parent}_{field}" if field.endswith(child) else f"{parent}_{field}_{child}"
