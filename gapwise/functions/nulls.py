"""Null rules of data frames that treat missing values as values, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that a reader of delimited files takes for missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def strip(c: Column) -> Column:
    """Without white space at either end; ``trim`` takes spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def differs(c: Column, value) -> Column:
    """True where ``c`` is another value or missing."""
    return ~c.eqNullSafe(F.lit(value))


def share(cond: Column) -> Column:
    """Mean of a condition in which a missing value counts as false."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def total(c: Column) -> Column:
    """Sum that is 0, not null, if there is nothing to add."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def optional(df, name: str, kind: str = "string") -> Column:
    """The column if the frame has it, else a null of ``kind``."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)
