"""Registration of queries, and the analogues that stand in for the applied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ORACLES, QUERIES


def query(sql: str | None = None) -> Callable:
    """Register a function (t) -> DataFrame under its name; ``t(name)`` reads a table."""

    def put(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **more: int) -> DataFrame:
    """All double columns rounded; a negative zero becomes zero."""
    return df.select(*[(F.round(c, more.get(c, digits)) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])
