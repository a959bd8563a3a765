"""CSV whose types come from the data, also as a relation of SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import na_to_null
from .delimited import read_csv

# What texts a column holds, as bits, so that sums over tasks merge by OR.
TRUTH, WHOLE, REAL, WIDE, OTHER = 1, 2, 4, 8, 16

# Texts that a reader of delimited files takes for truth values.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

_WHOLE = r"^\s*[-+]?[0-9]+\s*$"
_REAL = r"^\s*[-+]?([0-9]+\.?[0-9]*([eE][-+]?[0-9]+)?|\.[0-9]+([eE][-+]?[0-9]+)?|[iI]nf|[iI]nfinity)\s*$"


def _number(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def _kind(c: Column) -> Column:
    """The bit of one text; 0 if it means missing."""
    whole = F.when(_number(c).try_cast("bigint").isNotNull(), WHOLE).otherwise(WIDE)
    return F.when(c.isNull(), 0).when(c.isin(TRUE_TOKENS + FALSE_TOKENS), TRUTH).when(c.rlike(_WHOLE), whole).when(c.rlike(_REAL), REAL).otherwise(OTHER)


def _type(bits: int | None) -> str:
    """The least type that holds all texts of a column."""
    if bits is None or bits & OTHER or (bits & TRUTH and bits != TRUTH):
        return "string"
    if bits == TRUTH:
        return "boolean"
    if bits & REAL or bits == 0:
        return "double"
    return "string" if bits & WIDE else "bigint"


def infer_types(texts: DataFrame, text: tuple[str, ...] = ()) -> dict[str, str]:
    """The type of each text column of ``texts``, from all rows, in one pass to one row; nulls are missing.

    Truth values only: boolean. Whole numbers within 64 bits: bigint, whether
    some are missing or not. Numbers of which one is no whole number: double.
    Whole numbers of which one is beyond 64 bits stay text, so that no digit is
    lost; so does every other mixture. Missing values only: double; no rows at
    all: text. Columns named in ``text`` are not looked at (codes with leading
    zeros would lose them).
    """
    ask = [c for c in texts.columns if c not in text]
    seen = texts.agg(*[F.bit_or(_kind(F.col(f"`{c}`"))).alias(f"b{k}") for k, c in enumerate(ask)]).first() if ask else ()
    return {c: "string" for c in texts.columns} | {c: _type(b) for c, b in zip(ask, seen)}


def typed(texts: DataFrame, types: dict[str, str]) -> DataFrame:
    """``texts`` with the columns cast as ``infer_types`` says."""

    def cast(c: str) -> Column:
        x, k = F.col(f"`{c}`"), types[c]
        if k == "boolean":
            x = x.isin(TRUE_TOKENS)
        elif k != "string":
            x = _number(x).cast(k)
        return x.alias(c)

    return texts.select(*[cast(c) for c in texts.columns])


def read_typed_csv(spark: SparkSession, path: str, text: tuple[str, ...] = (), **options) -> DataFrame:
    """A CSV with a header whose types are those of all its rows; texts that mean missing are null.

    The types take one job over the file when this is called. A later read that
    needs few columns still parses whole lines, but keeps only those columns.
    """
    raw = read_csv(spark, path, na=False, **options)
    raw = raw.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return typed(raw, infer_types(raw, text))


def csv_relation(spark: SparkSession, name: str, path: str, text: tuple[str, ...] = (), typed: bool = True, **options) -> DataFrame:
    """A CSV under ``name`` in SQL, with types from the data or, if not ``typed``, all columns as text."""
    df = read_typed_csv(spark, path, text, **options) if typed else read_csv(spark, path, **options)
    df.createOrReplaceTempView(name)
    return df
