"""Names and junk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import strip


def normalize_lga_name(c: Column) -> Column:
    """Trimmed, without a trailing area suffix, single spaced, lower case."""
    t = strip(c)
    t = F.regexp_replace(t, r"(?i)\s+lga\s*$", "")
    t = F.regexp_replace(t, r"(?i)\s+local\s+govt\s+area\s*$", "")
    return F.lower(F.regexp_replace(strip(t), r"\s+", " "))


def is_junk_name(c: Column, junk: str = "unnamed facility") -> Column:
    """Never null: a missing name is no junk."""
    return F.lower(strip(c)).eqNullSafe(F.lit(junk))


def is_data_row(c: Column, footer: str = "TOTAL") -> Column:
    """Neither blank nor the footer of a sheet."""
    t = strip(c)
    return c.isNotNull() & (t != "") & (F.upper(t) != footer)


def mentions(c: Column, word: str) -> Column:
    """Case-insensitive contains; a missing text mentions nothing."""
    return F.coalesce(F.lower(c).contains(word.lower()), F.lit(False))


def agrees(own: Column, other: Column) -> Column:
    """Three-valued equality of normalised names; null if ``own`` is missing."""
    return F.when(own.isNotNull(), F.coalesce(normalize_lga_name(own) == normalize_lga_name(other), F.lit(False)))
