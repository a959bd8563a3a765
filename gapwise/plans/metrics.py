"""Stage metrics that travel with each stage's own job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: A stage: its name, what it does, and what is measured of the rows that it gives.
Stage = tuple[str, Callable[[DataFrame], DataFrame], dict[str, Column]]


def spread(*columns: str) -> dict[str, Column]:
    """Nulls, least and greatest of numeric columns."""
    out = {}
    for c in columns:
        out |= {f"{c}_missing": F.count_if(F.col(c).isNull()), f"{c}_least": F.min(c), f"{c}_most": F.max(c)}
    return out


def shares(column: str, values: list[str]) -> dict[str, Column]:
    """How many rows hold each of the known ``values`` of ``column``."""
    return {f"{column}_{v}": F.count_if(F.col(column) == v) for v in values}


def run_stages(df: DataFrame, stages: list[Stage], folder: str) -> tuple[DataFrame, DataFrame]:
    """(the last stage's rows, metrics as stage_no, stage, metric, value).

    Each stage is written as Parquet below ``folder`` and reread, and its
    metrics are observed while it is written: no rows are read for them alone.
    Every stage has ``rows_in``, ``rows_out`` and ``rows_dropped`` (negative
    if it adds rows) and what it asks for itself, as doubles; null if no row
    has a value. ``rows_in`` is what the stage before gave out; for the first it
    is observed where rows enter, so the first stage must read its input once
    and start no job of its own. What is observed where a stage ends is exact
    even if executors are lost; where rows enter it is if no exchange follows.
    """
    spark, found, before = df.sparkSession, [], None
    for no, (name, work, asked) in enumerate(stages):
        entered, left = Observation(), Observation()
        # only the first input has not been counted yet
        given = df.observe(entered, F.count(F.lit(1)).alias("rows")) if before is None else df
        out = work(given)
        kept = {f"m{k}": c for k, c in enumerate(asked.values())}
        out = out.observe(left, F.count(F.lit(1)).alias("rows"), *[c.cast("double").alias(k) for k, c in kept.items()])
        out.write.mode("overwrite").parquet(f"{folder}/{no}-{name}")
        own = left.get
        rows_in = entered.get["rows"] if before is None else before
        before = own["rows"]
        rows = {"rows_in": rows_in, "rows_out": before, "rows_dropped": rows_in - before}
        rows |= dict(zip(asked, (own[k] for k in kept)))
        found += [(no, name, k, None if v is None else float(v)) for k, v in rows.items()]
        df = spark.read.parquet(f"{folder}/{no}-{name}")
    return df, spark.createDataFrame(found, "stage_no int, stage string, metric string, value double")
