"""Tables written in buckets of their key, so that joins on it move no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None) -> DataFrame:
    """``df`` as the table ``name`` in ``buckets`` sorted by ``keys``, replaced if it exists; returns the table.

    Rows are dealt by the same hash that buckets go by, so each bucket is one
    task and one file. Tables that are joined on ``keys`` need equal numbers of
    buckets, or one a multiple of the other. Choose it so that a bucket of the
    larger table fits in a task: some hundred MB. Rows with a null key share a
    bucket, and so do those of a key that is very frequent: where one key holds
    a large share of the rows, an exchange that AQE can split is better.
    """
    w = df.repartition(buckets, *[F.col(f"`{k}`") for k in keys]).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (w.option("path", path) if path else w).saveAsTable(name)
    return df.sparkSession.table(name)
